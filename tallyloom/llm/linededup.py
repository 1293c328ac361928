"""Line dedup by pairwise alignment of documents that share lines.

Every line is keyed by its hash and its occurrence number in its document, so that the keys of one
document are distinct. A block is a run of lines that follow one another in two documents, blank lines
aside; it goes from the later one if the run as a whole has `min_chars` characters. No count of
documents has a part in that.

Partners are met by windows, the shortest runs of so many characters from each line on and up to each
line: every line of a block lies in a window inside the block, and every window has one first holder
(least id), so that the pairs are as many as the windows, whatever the group size, and a line that was
first seen elsewhere does not tear a block. The lines of a pair's windows are aligned as patience diff
does, by the longest increasing sequence of common lines, and what it leaves (moved blocks) again.

With `Rules` a document is aligned once with the first holder of each single line, and blocks go if they
hold a line that is rare by `rare_docs`, or several lines.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.util import bounded, cut, partitions

LOWEST = -(1 << 63)
MIN_CHARS = 24  # of a whole block


@dataclass(frozen=True)
class Rules:
    min_chars: int = 24  # a shorter line never makes a block by itself
    rare_docs: int = 1000  # a line in more documents than that is no evidence by itself (a licence line, say)
    min_lines: int = 2  # of a block without a rare line


def lines_of(x: str) -> list[tuple[int, int, int, int]]:
    """(number, number among non-blank lines, key, length) of the non-blank lines."""
    out, seen, n = [], {}, 0
    for no, line in enumerate(x.split("\n")):
        plain = line.strip()
        if plain:
            h = xxhash.xxh64_intdigest(plain)
            k = seen[h] = seen.get(h, -1) + 1
            out.append((no, n, (h + k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, len(plain)))
            n += 1
    return out


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Indices of a longest run of pairs increasing in a; the pairs are in the order of b."""
    tails, at, back = [], [], []
    for i, x in enumerate(a):
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
        at[k : k + 1] = [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def deleted(a: list[int], b: list[int], size: list[int], df: list[int], rules: Rules) -> tuple[list[int], int]:
    """(places in b, number of blocks) to delete from the later document; a and b are places among non-blank lines, in the order of b."""
    gone: list[int] = []
    blocks, run = 0, []

    def close():
        nonlocal blocks
        rare = any(size[i] >= rules.min_chars and df[i] <= rules.rare_docs for i in run)
        if rare or (len(run) >= rules.min_lines and max(size[i] for i in run) >= rules.min_chars):
            gone.extend(b[i] for i in run)
            blocks += 1

    for i in aligned(a, b):
        if run and (a[i] != a[run[-1]] + 1 or b[i] != b[run[-1]] + 1):
            close()
            run = []
        run.append(i)
    if run:
        close()
    return gone, blocks


def windows(keys: list[int], size: list[int], least: int) -> set[tuple[int, int]]:
    """(from, to) of the shortest runs of at least so many characters from each line on, and up to each line."""
    out, n, total, j = set(), len(keys), 0, 0
    for i in range(n):
        while j < n and total < least:
            total += size[j]
            j += 1
        if total < least:
            break
        out.add((i, j))
        total -= size[i]
    total, i = 0, n
    for j in range(n, 0, -1):
        while i > 0 and total < least:
            i -= 1
            total += size[i]
        if total < least:
            break
        out.add((i, j))
        total -= size[j - 1]
    return out


def aligned_blocks(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """(first, length) in b of the blocks that alignments of the pairs, in the order of b, find: the first one, then those of what it leaves (moved blocks), until none is left."""
    blocks: list[tuple[int, int]] = []
    while a:
        at = aligned(a, b)
        for k, i in enumerate(at):
            if k and a[i] == a[at[k - 1]] + 1 and b[i] == b[at[k - 1]] + 1:
                blocks[-1] = (blocks[-1][0], blocks[-1][1] + 1)
            else:
                blocks.append((b[i], 1))
        rest = sorted(set(range(len(a))) - set(at))
        a, b = [a[i] for i in rest], [b[i] for i in rest]
    return blocks


HOT_SHARE = 1000


def with_first_holders(every: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of `every` (a cut table) whose key others hold too, with the first of these as odid, oth and on, but for the holders' own rows.

    Keys that hold more than one in HOT_SHARE rows, at most HOT_SHARE of them, are broadcast, so that none goes to one task.
    """
    shared = cut(every.groupBy("key").agg(F.min(F.struct("did", "th", "n")).alias("first"), F.count("*").alias("df")).where("df > 1"))
    most = max(1000, every.count() // HOT_SHARE)
    hot, cold = F.broadcast(shared.where(F.col("df") > most)), shared.where(F.col("df") <= most)
    met = every.join(hot, "key").union(every.join(hot, "key", "left_anti").join(cold, "key")).where("first.did <> did OR first.th <> th")
    return met.select("did", "th", F.col("first.did").alias("odid"), F.col("first.th").alias("oth"), "n", F.col("first.n").alias("on"), *columns)


def slim_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return bounded(docs).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("did"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))


def block_deletions(docs: DataFrame, min_chars: int, doc_id: str, text: str) -> DataFrame:
    """(did, th, gone, blocks) of the documents that lose lines, by windows: places among their non-blank lines."""

    def run(it):
        for pdf in it:
            rows = []
            for d, t, x in zip(pdf["did"], pdf["th"], pdf["text"]):
                if not isinstance(x, str):
                    continue
                own = lines_of(x)
                keys, size = [r[2] for r in own], [r[3] for r in own]
                packed = np.array(keys, "<u8").tobytes()
                rows += [(d, t, i, j - i, xxhash.xxh64_intdigest(packed[8 * i : 8 * j]) - (1 << 63)) for i, j in windows(keys, size, min_chars)]
            out = np.array(rows, np.int64).reshape(-1, 5)
            yield pd.DataFrame({"did": out[:, 0], "th": out[:, 1], "n": out[:, 2].astype("i4"), "len": out[:, 3].astype("i4"), "key": out[:, 4]})

    every = cut(slim_of(docs, doc_id, text).mapInPandas(run, "did long, th long, n int, len int, key long"))
    met = with_first_holders(every, ["len"])
    met = met.repartition(partitions(docs), "did", "th").sortWithinPartitions("did", "th", "odid", "oth", "n")

    def align(it):
        doc, pair, held, gone, blocks = None, None, {}, set(), 0

        def pair_done():
            nonlocal blocks
            b = sorted(held)
            found = aligned_blocks([held[i] for i in b], b)
            blocks += len(found)
            for first, size in found:
                gone.update(range(first, first + size))
            held.clear()

        for pdf in it:
            out = []
            for d, t, od, ot, n, on, size in zip(*[pdf[c].tolist() for c in pdf.columns]):
                if (d, t, od, ot) != pair:
                    pair_done()
                    if (d, t) != doc:
                        if gone:
                            out.append((*doc, sorted(gone), blocks))
                        doc, gone, blocks = (d, t), set(), 0
                    pair = (d, t, od, ot)
                held.update(zip(range(n, n + size), range(on, on + size)))
            yield pd.DataFrame(out, columns=["did", "th", "gone", "blocks"])
        pair_done()
        yield pd.DataFrame([(*doc, sorted(gone), blocks)] if gone else [], columns=["did", "th", "gone", "blocks"])

    return met.mapInPandas(align, "did long, th long, gone array<int>, blocks long")


def deletions(docs: DataFrame, rules: Rules, doc_id: str, text: str) -> DataFrame:
    """(did, th, gone, blocks) of the documents that lose lines: places among their non-blank lines."""
    slim = slim_of(docs, doc_id, text)

    def run(it):
        for pdf in it:
            rows = [(d, t, n, k, size) for d, t, x in zip(pdf["did"], pdf["th"], pdf["text"]) if isinstance(x, str) for _, n, k, size in lines_of(x)]
            out = np.array([(d, t, n, k - (1 << 64) if k >> 63 else k, size) for d, t, n, k, size in rows], np.int64).reshape(-1, 5)
            yield pd.DataFrame({"did": out[:, 0], "th": out[:, 1], "n": out[:, 2].astype("i4"), "key": out[:, 3], "size": out[:, 4].astype("i4")})

    every = cut(slim.mapInPandas(run, "did long, th long, n int, key long, size int"))
    met = with_first_holders(every, ["size", "df"])
    met = met.repartition(partitions(docs), "did", "th").sortWithinPartitions("did", "th", "odid", "oth", "n")

    def align(it):
        doc, pair, held, gone, blocks = None, None, [], [], 0

        def pair_done():
            nonlocal blocks
            if held:
                # identical rows repeat each place; one of each is enough
                own = [x for i, x in enumerate(held) if not i or x[0] != held[i - 1][0]]
                g, k = deleted([x[1] for x in own], [x[0] for x in own], [x[2] for x in own], [x[3] for x in own], rules)
                gone.extend(g)
                blocks += k
                held.clear()

        for pdf in it:
            out = []
            for d, t, od, ot, n, on, size, df in zip(*[pdf[c].tolist() for c in pdf.columns]):
                if (d, t, od, ot) != pair:
                    pair_done()
                    if (d, t) != doc:
                        if gone:
                            out.append((*doc, sorted(set(gone)), blocks))
                        doc, gone, blocks = (d, t), [], 0
                    pair = (d, t, od, ot)
                held.append((n, on, size, df))
            yield pd.DataFrame(out, columns=["did", "th", "gone", "blocks"])
        pair_done()
        yield pd.DataFrame([(*doc, sorted(set(gone)), blocks)] if gone else [], columns=["did", "th", "gone", "blocks"])

    return met.mapInPandas(align, "did long, th long, gone array<int>, blocks long")


def dedup_lines(docs: DataFrame, rules: Rules | None = None, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the aligned common blocks deleted from the text of the later documents, and n_lines, n_deleted, n_blocks (non-blank lines, those deleted, blocks).

    The earlier of two documents is the one with the lesser id (null first), then text hash. Nothing
    is deleted within a document. Null text stays null and an untouched text stays as it is, byte
    for byte; a text that loses all lines becomes empty. Lines are compared without the white space
    at their ends. Rows alike in id and text count as one document and keep their text. Other
    columns keep their values; one named like a result column is replaced. An empty table gives an
    empty table.
    """
    gone = (block_deletions(docs, min_chars, doc_id, text) if rules is None else deletions(docs, rules, doc_id, text)).select(F.col("did").alias("__did"), F.col("th").alias("__th"), F.col("gone").alias("__gone"), F.col("blocks").alias("__blocks"))
    mine = F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)) == F.col("__did")
    out = docs.join(gone, mine & (F.xxhash64(F.col(text)) == F.col("__th")), "left")

    @F.pandas_udf("text string, n_lines long")
    def strip(x: pd.Series, g: pd.Series) -> pd.DataFrame:
        texts, counts = [], []
        for t, places in zip(x, g):
            if not isinstance(t, str):
                texts.append(None)
                counts.append(0)
                continue
            lines = t.split("\n")
            full = [bool(y.strip()) for y in lines]
            counts.append(sum(full))
            if places is not None and len(places):
                drop, n, kept = set(np.asarray(places).tolist()), -1, []
                for y, f in zip(lines, full):
                    n += f
                    if not f or n not in drop:
                        kept.append(y)
                t = "\n".join(kept) if any(y.strip() for y in kept) else ""
            texts.append(t)
        return pd.DataFrame({"text": pd.Series(texts, dtype=object), "n_lines": counts})

    out = out.withColumn("__r", strip(F.col(text), F.col("__gone")))
    out = out.withColumns({text: F.col("__r.text"), "n_lines": F.col("__r.n_lines"), "n_deleted": F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long"), "n_blocks": F.coalesce("__blocks", F.lit(0)).cast("long")})
    return out.drop("__r", "__did", "__th", "__gone", "__blocks")
