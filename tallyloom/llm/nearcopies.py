"""Near-duplicate documents by SimHash fingerprints and May-Ozerov recursion.

A document's fingerprint is the 256-bit SimHash of its distinct word pairs. Fingerprints at Hamming
distance up to `radius` are linked. One repetition draws random strips of 7 coordinates and, for
each strip, a random coset of the [7,4] Hamming code as centres; a list keeps the fingerprints whose
weight against its centre on the strip is at most 1 (every fingerprint lies in exactly one such list
per strip). Lists are recursed into with fresh strips until they are small, and then searched by
brute force. The first strips send the fingerprints out; the last ones, and their own repetitions, are
run within the task that holds a list. Repetitions run until two fingerprints at the radius meet with
the target probability.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.util import bounded, cut, encoded, mix, partitions, slices, words
from tallyloom.operators.graph import connected_components

BITS, STRIP, RADIUS, RECALL, LIST_SIZE, LIST_MOST, DEPTHS = 256, 7, 52, 0.95, 1024, 32768, 3
WORDS, LONG_RUN = BITS // 64, 64
#: Of sending a fingerprint out, in repetitions within a list; pairs of which it is looked at a time whether they met before.
SEND_COST, PAIRS = 2, 1 << 20
_RUN = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]{22,}")
LOWEST = -(1 << 63)
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[:128] = [i if chr(i).isalnum() else 32 for i in range(128)]


@lru_cache(1)
def decoder() -> np.ndarray:
    """The number of the Hamming codeword within distance 1 of each 7-bit word."""
    code = [w for w in range(128) if all(bin(w & m).count("1") % 2 == 0 for m in (0b1010101, 0b0110011, 0b0001111))]
    return np.array([next(i for i, c in enumerate(code) if bin(c ^ w).count("1") <= 1) for w in range(128)], np.uint8)


def meeting(distance: int, levels: int) -> float:
    """Probability that two fingerprints at a distance share a list after so many strips."""
    p = distance / BITS
    same = (1 - p) ** 7 + (7 * p * (1 - p) ** 6 + 21 * p**2 * (1 - p) ** 5) / 4
    return same**levels


def repetitions(levels: int, radius: int = RADIUS, recall: float = RECALL) -> int:
    return 1 if levels == 0 else math.ceil(math.log(1 - recall) / math.log(1 - meeting(radius, levels)))


def plan(n: int, radius: int = RADIUS, recall: float = RECALL, list_size: int = LIST_SIZE) -> tuple[int, int, int, int]:
    """(strips by which n fingerprints are sent out, repetitions, strips within such a list, repetitions there); the last two are 0 and 1 where one strip makes lists of list_size."""
    levels = max(0, math.ceil(math.log(max(1, n) / list_size, 16) - 1e-9)) if n > list_size else 0
    if levels < 2:
        return levels, repetitions(levels, radius, recall), 0, 1
    strips = min(2, levels - 1)
    outer, inner = meeting(radius, levels - strips), meeting(radius, strips)
    reps = lambda passes: math.ceil(math.log(1 - recall) / math.log(1 - outer * (1 - (1 - inner) ** passes)))
    passes = min(range(1, 129), key=lambda k: reps(k) * (SEND_COST + k))
    return levels - strips, reps(passes), strips, passes


def unblanked(text: str) -> str:
    """The text with blanks in its long runs without one: around each letter of a script from Thai on (most of which don't part words), elsewhere after the letters that a hash picks, a quarter of all, so that an edit moves few of the cuts."""
    cut_up = lambda m: "".join(f" {c} " if c >= "\u0e00" else f"{c} " if ord(c) * 0x9E3779B1 >> 16 & 3 == 0 else c for c in m[0])
    return _RUN.sub(cut_up, text)


def parted(texts: list[str]) -> list[str]:
    """texts, those with a run of over LONG_RUN bytes without a blank being cut up."""
    raw = encoded(texts)
    out = list(texts)
    for a, b in slices(raw):
        buf = np.frombuffer(b" ".join(raw[a:b]) + b" ", np.uint8)
        blank = np.flatnonzero(_TABLE[buf] == 32)
        long = blank[:-1][np.diff(blank) > LONG_RUN] if len(blank) > 1 else blank[:0]
        if len(blank) and blank[0] > LONG_RUN:
            long = np.append(long, 0)
        if len(long):
            first = np.cumsum([0] + [len(x) + 1 for x in raw[a : b - 1]])
            for i in np.unique(np.searchsorted(first, long + 1, "right") - 1):
                out[a + i] = unblanked(texts[a + i])
    return out


def simhash(texts) -> np.ndarray:
    """(n, WORDS) fingerprints. Case and ASCII punctuation don't matter; a text without a word is hashed as it is."""
    texts = parted([x.lower() if isinstance(x, str) else "" for x in texts])
    raw = encoded(texts)
    out = np.zeros((len(raw), WORDS), np.uint64)
    salts = mix(np.arange(1, WORDS + 1, dtype=np.uint64))
    for a, b in slices(raw):
        plain = [_TABLE[np.frombuffer(x, np.uint8)].tobytes() for x in raw[a:b]]
        h, counts, _ = words(plain)
        at = 0
        for i, n in enumerate(counts, a):
            w = h[at : at + n]
            at += n
            if n == 0:
                digest = int.from_bytes(raw[i], "little") % ((1 << 61) - 1) if raw[i] else 0
                out[i] = mix(np.full(WORDS, digest, np.uint64) + salts)
                continue
            f = np.unique(mix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])) if n > 1 else w
            ones = np.zeros(BITS, np.int64)
            for k in range(0, len(f), 65280):
                part = f[k : k + 65280]
                bits = np.unpackbits(mix(part[:, None] ^ salts[None, :]).view(np.uint8).reshape(len(part), BITS // 8), axis=1)
                for r in range(0, len(part), 255):
                    ones += np.add.reduce(bits[r : r + 255], axis=0, dtype=np.uint8)
            out[i] = np.packbits(2 * ones >= len(f)).view(np.uint64)
    return out


def lists(bits: np.ndarray, seed: tuple[int, ...], levels: int) -> np.ndarray:
    """The list of each fingerprint (rows of BITS bits) after so many random strips."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(BITS)[: STRIP * levels]
    shift = rng.integers(0, 128, levels, dtype=np.uint8)
    out = np.zeros(len(bits), np.uint64)
    for k in range(levels):
        word = np.packbits(bits[:, order[STRIP * k : STRIP * k + STRIP]], axis=1)[:, 0] >> 1
        out = out << np.uint64(4) | decoder()[word ^ shift[k]].astype(np.uint64)
    return out


def bits_of(f: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1)


def close_pairs(f: np.ndarray, radius: int, block: int = 128):
    """Yields (i, j), i < j, of the rows of f within the radius. First come as many words as tell unrelated fingerprints, three standard deviations off, from near ones."""
    n = len(f)
    first = next((k for k in (2, 3) if 32 * k - radius >= 12 * math.sqrt(k)), 3)
    cols = [np.ascontiguousarray(f[:, k]) for k in range(WORDS)]
    for a in range(0, n, block):
        b = min(n, a + block)
        d = np.bitwise_count(cols[0][a:b, None] ^ cols[0][None, a:])
        for c in cols[1:first]:
            d += np.bitwise_count(c[a:b, None] ^ c[None, a:])
        i, j = np.divmod(np.flatnonzero(d <= radius), n - a)
        keep = j > i
        i, j = i[keep] + a, j[keep] + a
        if len(i):
            rest = np.bitwise_count(f[i] ^ f[j]).sum(1) <= radius
            if rest.any():
                yield i[rest], j[rest]


def hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after uniting the pairs; a label is the least index of its set."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def search(f: np.ndarray, block: np.ndarray, radius: int, met) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, root, links) of the linked members of one list: the least member that it is connected to, and how many it is linked to for the first time. In a list of two blocks only pairs across them count. met: see met_before; without it no links are counted."""
    across = bool((block != block[0]).any())
    label, links, hit = np.arange(len(f)), np.zeros(len(f), np.int64), np.zeros(len(f), bool)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def count():
        i, j = (np.concatenate(x) for x in zip(*held))
        held.clear()
        own, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        new = ~met(f[own], at[: len(i)], at[len(i) :])
        for x in (i, j):
            links[:] += np.bincount(x[new], minlength=len(f))

    for i, j in close_pairs(f, radius):
        if across:
            other = block[i] != block[j]
            i, j = i[other], j[other]
        label = hook(label, i, j)
        hit[i] = hit[j] = True
        if met and len(i):
            held.append((i, j))
            if sum(len(x) for x, _ in held) >= PAIRS:
                count()
    if held:
        count()
    k = np.flatnonzero(hit)
    return k, label[k], links[k]


def inside_list(f: np.ndarray, path: tuple[int, ...], s: int, strips: int) -> np.ndarray:
    """The part, by repetition s within the list at this path, of each of its members."""
    return np.concatenate([lists(bits_of(f[a : a + 65536]), (78, path[0], len(path), s), strips) for a in range(0, len(f), 65536)])


def search_parts(ids: np.ndarray, f: np.ndarray, block: np.ndarray, radius: int, path: tuple[int, ...], strips: int, passes: int, met) -> pd.DataFrame:
    """(id, root, links) of the linked members of the list at this path, which is searched in the parts that its repetitions make of it. met: see met_before, of a repetition."""
    label, links, hit = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    for s in range(passes):
        part = inside_list(f, path, s, strips).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        edges = [0, *(np.flatnonzero(np.diff(part[order])) + 1), len(order)]
        pairs = []
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                own = order[a:b]
                k, root, n = search(f[own], block[own], radius, met and met(s))
                if len(k):
                    pairs.append((own[k], own[root]))
                    links[own[k]] += n
        if pairs:
            i, j = (np.concatenate(x) for x in zip(*pairs))
            label = hook(label, i, j)
            hit[i] = True
    k = np.flatnonzero(hit)
    return pd.DataFrame({"id": ids[k], "root": ids[label[k]], "links": links[k]})


def inner_list(outer: np.ndarray, bits: np.ndarray, depth: int, s: int) -> np.ndarray:
    """The list at this depth, by inner repetition s, of each member of an outer list."""
    own = lists(bits, (77, depth, s), 2) + np.uint64(s << 8)
    return mix(outer ^ mix(own + np.uint64(depth << 32)))


def path_of(rep: int) -> tuple[int, ...]:
    """(repetition, inner repetition at depth 1, 2, ...) from 16 bits and then 12 bits each, which hold one more than the number."""
    rep &= (1 << 64) - 1
    out, rep = [rep & 0xFFFF], rep >> 16
    while rep:
        out.append((rep & 0xFFF) - 1)
        rep >>= 12
    return tuple(out)


def met_before(path: tuple[int, ...], levels: int, inner: list[int], hot: list[np.ndarray], strips: int = 0, passes: int = 1):
    """A function of a repetition s within the list at this path, which gives one of fingerprints and index arrays (i, j) into them: whether these members of a part of that list meet in an earlier part, too.

    Lists in hot[d] are recursed into with inner[d] repetitions, so that sharing one is not meeting; in any other list a pair meets
    if it shares one of the parts that the `passes` repetitions within the list make by `strips`.
    """

    def of(s, f, i, j):
        bits, held = bits_of(f), {}

        def key(at):
            if at not in held:
                if len(held) >= 96:
                    held.clear()
                held[at] = mix(lists(bits, at, levels) + np.uint64(at[0] << 48)) if len(at) == 1 else inner_list(key(at[:-1]), bits, len(at) - 1, at[-1])
            return held[at]

        def inside(at, upto, i, j):
            if not strips:
                return np.full(len(i), upto > 0)
            out = np.zeros(len(i), bool)
            for t in range(upto):
                left = np.flatnonzero(~out)
                if not len(left):
                    break
                own, k = np.unique(np.concatenate([i[left], j[left]]), return_inverse=True)
                part = inside_list(f[own], at, t, strips)[k]
                out[left] = part[: len(left)] == part[len(left) :]
            return out

        def earlier(base, upto, i, j):
            out = np.zeros(len(i), bool)
            for t in range(upto):
                left = np.flatnonzero(~out)
                if not len(left):
                    break
                k = key((*base, t))
                left = left[k[i[left]] == k[j[left]]]
                if len(left):
                    out[left] = below((*base, t), i[left], j[left])
            return out

        def below(at, i, j):
            d = len(at) - 1
            cold = ~np.isin(key(at)[i], hot[d]) if d < len(hot) else np.ones(len(i), bool)
            out = np.zeros(len(i), bool)
            for which, look, upto in ((cold, inside, passes), (~cold, earlier, inner[d] if d < len(hot) else 0)):
                left = np.flatnonzero(which)
                if len(left):
                    out[left] = look(at, upto, i[left], j[left])
            return out

        out = np.zeros(len(i), bool)
        for d, upto in enumerate(path):
            left = np.flatnonzero(~out)
            out[left] = earlier(path[:d], upto, i[left], j[left])
        left = np.flatnonzero(~out)
        out[left] = inside(path, s, i[left], j[left])
        return out

    return lambda s: lambda f, i, j: of(s, f, i, j)


def links_of(prints: DataFrame, radius: int, recall: float, list_size: int, list_most: int, depths: int, counted: bool = True) -> DataFrame:
    """Rows (id, root, links) over rows (id, f0..f3) of distinct fingerprints; without `counted` links are 0.

    Lists of over list_most rows, sixteen times as many where they are searched in parts, are recursed into, up to `depths` times. What is over it even then (fingerprints that
    differ in few bits) is searched in pairs of blocks, each a task's work: exact, and never gathered whole.
    """
    n, width = prints.count(), partitions(prints)
    levels, reps, strips, passes = plan(n, radius, recall, list_size)
    list_most *= 16 if strips else 1
    cols = [f"f{k}" for k in range(WORDS)]
    flat = ", ".join(f"{c} long" for c in cols)
    table = lambda pdf: np.ascontiguousarray(pdf[cols].to_numpy(np.int64)).view(np.uint64)

    def spread(it):
        for pdf in it:
            bits = bits_of(table(pdf))
            for r in range(reps):
                key = mix(lists(bits, (r,), levels) + np.uint64(r << 48)).view(np.int64)
                yield pdf.assign(list=key, rep=r, block=0)

    schema = f"id long, {flat}, list long, rep long, block long"
    rows = prints.mapInPandas(spread, schema)
    over = lambda: rows.groupBy("list").count().where(F.col("count") > list_most).collect()  # noqa: E731, at most one in list_most rows
    inner: list[int] = []  # repetitions by depth: the misses of all depths add up to those of the recall
    split: list[np.ndarray] = []  # the lists that are recursed into, by depth; each has over list_most rows
    while n > list_most:
        big = sorted((np.int64(k).astype(np.uint64), m) for k, m in over())
        if not big:
            break
        found, depth = np.array([k for k, _ in big], np.uint64), len(split) + 1
        if depth > depths:
            blocks = np.array([-(-2 * m // list_most) for _, m in big], np.int64)

            def paired(it, found=found, blocks=blocks):
                for pdf in it:
                    key = pdf["list"].to_numpy(np.int64).view(np.uint64)
                    hot = np.isin(key, found)
                    yield pdf[~hot]
                    pdf, key = pdf[hot], key[hot]
                    if len(pdf):
                        n_blocks = blocks[np.searchsorted(found, key)]
                        own = (mix(pdf["id"].to_numpy(np.int64).view(np.uint64)) % n_blocks.astype(np.uint64)).astype(np.int64)
                        for k in range(int(n_blocks.max())):
                            use = n_blocks > k
                            lo, hi = np.minimum(own, k)[use].astype(np.uint64), np.maximum(own, k)[use].astype(np.uint64)
                            yield pdf[use].assign(list=mix(key[use] ^ mix((lo << np.uint64(32)) + hi + np.uint64(1))).view(np.int64), block=own[use])

            rows = cut(rows.mapInPandas(paired, schema))
            break
        split.append(found)
        inner.append(repetitions(2, radius, 1 - (1 - recall) / 2**depth))

        def deeper(it, found=found, depth=depth, count=inner[-1]):
            for pdf in it:
                hot = np.isin(pdf["list"].to_numpy(np.int64).view(np.uint64), found)
                yield pdf[~hot]
                pdf = pdf[hot]
                if not len(pdf):
                    continue
                bits, outer, rep = bits_of(table(pdf)), pdf["list"].to_numpy(np.int64).view(np.uint64), pdf["rep"].to_numpy(np.int64)
                for s in range(count):
                    path = rep | np.array((s + 1) << (4 + 12 * depth), np.uint64).view(np.int64)
                    yield pdf.assign(list=inner_list(outer, bits, depth, s).view(np.int64), rep=path)

        rows = cut(rows.mapInPandas(deeper, schema))
    known = prints.sparkSession.sparkContext.broadcast(split)

    def brute(it):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        own = rep = None

        def done():
            ids, f, block = (np.concatenate(x) for x in zip(*held))
            path = path_of(rep)
            met = met_before(path, levels, inner, known.value, strips, passes) if counted else None
            return search_parts(ids, f, block, radius, path, strips, passes, met)

        for pdf in it:
            key, ids, f, block, reps_of = pdf["list"].to_numpy(), pdf["id"].to_numpy(np.int64), table(pdf), pdf["block"].to_numpy(np.int64), pdf["rep"].to_numpy(np.int64)
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(pdf)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and own != key[a]:
                    if sum(len(x) for x, *_ in held) > 1:
                        yield done()
                    held = []
                own, rep = key[a], int(reps_of[a])
                held.append((ids[a:b].copy(), f[a:b].copy(), block[a:b].astype(np.int32)))
        if sum(len(x) for x, *_ in held) > 1:
            yield done()

    rows = rows.repartition(width, "list").sortWithinPartitions("list")
    return rows.mapInPandas(brute, "id long, root long, links long").groupBy("id", "root").agg(F.sum("links").alias("links"))


def near_copies(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, list_size: int = LIST_SIZE, list_most: int = LIST_MOST, depths: int = DEPTHS, doc_id: str = "doc_id", text: str = "text", counted: bool = True) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), class_size, n_copies (documents with its fingerprint), n_links (other fingerprints and copies that it is linked to).

    Classes are the connected components of the links. Null text counts as empty; texts without a
    word are linked if they are equal. A null doc_id counts as the least id, and is returned as null; rows that share an id are
    documents of their own. Links are not lost to group sizes: copies are united by fingerprint
    before the search, and a list of over `list_most` members is recursed into with as many inner
    repetitions as keep the target recall, up to `depths` (at most 4) times, and beyond that searched in pairs of blocks.
    Other columns are ignored; an empty table gives an empty
    table. Without `counted`, n_links is null: which pairs met before is not looked up.
    """

    def run(it):
        for pdf in it:
            f = simhash(pdf["text"]).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "th": pdf["th"], **{f"f{k}": f[:, k] for k in range(WORDS)}})

    cols = [f"f{k}" for k in range(WORDS)]
    slim = bounded(docs).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    own = slim.mapInPandas(run, "doc_id long, th long, " + ", ".join(f"{c} long" for c in cols))
    own = cut(own.withColumn("id", F.xxhash64(*cols)))
    prints = cut(own.groupBy("id").agg(*[F.first(c).alias(c) for c in cols], F.min(F.struct("doc_id", "th")).alias("least"), F.count("*").alias("copies")))
    found = cut(links_of(prints.select("id", *cols), radius, recall, list_size, list_most, depths, counted))
    parts = connected_components(found.where("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst"))).select(F.col("node").alias("id"), "component")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = prints.select("id", "least", "copies").join(parts, "id").join(links, "id", "left")
    groups = linked.groupBy("component").agg(F.min("least").alias("first"), F.sum("copies").alias("class_size"))
    linked = linked.join(groups, "component").select("id", "first", "class_size", "copies", "links")
    alone = prints.where("copies > 1").join(parts, "id", "left_anti").select("id", F.col("least").alias("first"), F.col("copies").alias("class_size"), "copies", F.lit(0).cast("long").alias("links"))
    out = own.select("doc_id", "th", "id").join(linked.union(alone), "id", "left")
    back = lambda c: F.when(c != LOWEST, c)
    me = F.struct("doc_id", "th")
    return out.select(
        back(F.col("doc_id")).alias("doc_id"),
        back(F.coalesce("first.doc_id", "doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.when(F.lit(counted), F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.col("th").alias("text_hash"),
        (F.coalesce("first", me) == me).alias("is_first"),
    )


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one document of each class left, the one with the least id; of rows alike in id and text, any one."""
    classes = cut(near_copies(docs, doc_id=doc_id, text=text, counted=False, **options))
    gone = classes.where("NOT is_first").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th")).distinct()
    out = docs.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__th")), "left_anti")
    if not classes.where("is_first AND n_copies > 1").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([doc_id, text])
    return out
