"""A bigram language model by deleted interpolation.

P(w | v) = l2 c(v,w)/c(v) + l1 c(w)/N + l0 1/(V+1), the weights l depending on the bucket (log2) of
c(v). They are learned by expectation-maximisation on a part of the training documents that is kept
out of the counts meanwhile; the model then counts all training documents. The events of the
kept-out part enter EM as a histogram over (bucket, log c(v,w)/c(v), log c(w)/N) in quarter octaves,
which sums over all of them in one pass and is of bounded size.

Counts travel by the chunk exchange (see util): each chunk of documents asks for its distinct words
(64-bit hashes) and word pairs (hashes kept to 40 bits within a key partition, whose load does not
grow with the corpus, so that the odds of a clash stay at one in a million), and gets the corpus
counts back in the same order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.util import U64, chunked, crc_of_id, cut, encoded, key_partitions, mix, pack, serve, slices, unpack, words

CHUNK_BYTES, BUCKETS, STEPS, DELETED = 16 << 20, 48, 4, 8
LOWEST = -(1 << 63)
END = mix(np.array([0xE0D], U64))[0]
MAIN, KEPT_OUT, HELD = 0, 1, 2  # roles of documents
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def small(x: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds x."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.min_scalar_type(top))


def tokens_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, tokens of each text); every text ends with END."""
    parts, sizes = [], []
    for a, b in slices(raw):
        h, counts, _ = words(raw[a:b], lower=True)
        parts.append(np.insert(h, np.cumsum(counts), END))
        sizes.append(counts + 1)
    return (np.concatenate(parts), np.concatenate(sizes)) if parts else (np.zeros(0, U64), np.zeros(0, np.int64))


def make_chunk(rows: pd.DataFrame) -> list[tuple[int, bytes]]:
    out = []
    for kind in (0, 1):
        own = rows[(rows["role"] == KEPT_OUT) == bool(kind)]
        if len(own):
            t, n = tokens_of(encoded(own["text"]))
            vocabulary, place = np.unique(t, return_inverse=True)
            out.append((kind, pack(own["doc_id"].to_numpy(np.int64), own["role"].to_numpy(np.uint8), n, np.diff(vocabulary, prepend=U64(0)), place.astype(np.uint32))))
    return out


class Chunk:
    """The documents of a chunk as token events, with its distinct words and pairs in key order."""

    def __init__(self, blob: bytes, parts: int) -> None:
        self.ids, self.roles, self.sizes, gaps, self.place = unpack(blob)
        self.words = np.cumsum(gaps, dtype=U64)
        self.before = np.concatenate([[np.searchsorted(self.words, END)], self.place[:-1]]).astype(np.int64)
        drop = U64(max(0, 24 - max(1, parts - 1).bit_length()))
        w = self.words
        pair = mix(w[self.before] * U64(0x9E3779B97F4A7C15) + w[self.place]) >> drop << drop
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        self.drop = drop

    def counts(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and pair occurs in documents of a role."""
        use = np.repeat(self.roles == which, self.sizes)
        return np.bincount(self.place[use], minlength=len(self.words)), np.bincount(self.pair[use], minlength=len(self.pairs))

    def bounds(self, keys: np.ndarray, parts: int) -> np.ndarray:
        return np.searchsorted(((keys >> U64(32)) * U64(parts)) >> U64(32), np.arange(parts + 1, dtype=U64))


def ask(it, parts: int):
    for pdf in it:
        for chunk, kind, blob in zip(pdf["chunk"], pdf["kind"], pdf["blob"]):
            c = Chunk(blob, parts)
            w, p = c.counts(KEPT_OUT if kind else MAIN)
            wb, pb = c.bounds(c.words, parts), c.bounds(c.pairs, parts)
            rows = []
            for i in range(parts):
                a, b, x, y = wb[i], wb[i + 1], pb[i], pb[i + 1]
                if a < b or x < y:
                    gaps = np.diff(c.pairs[x:y] >> c.drop, prepend=U64(0))
                    first, gaps = gaps[:1], gaps[1:]
                    rows.append((i, chunk, kind, pack(c.words[a:b], small(w[a:b]), first, small(gaps), small(p[x:y]), np.array([c.drop], U64))))
            yield pd.DataFrame(rows, columns=["part", "chunk", "kind", "blob"])


def answer(pdf: pd.DataFrame) -> pd.DataFrame:
    asks = [unpack(b) for b in pdf["blob"]]
    kinds = pdf["kind"].tolist()
    done: list[list] = [[] for _ in asks]
    stats = []
    for keys, counts in (
        ([a[0] for a in asks], [a[1] for a in asks]),
        ([np.cumsum(np.concatenate([a[2], a[3].astype(U64)]), dtype=U64) << a[5][0] for a in asks], [a[4] for a in asks]),
    ):
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([0] + [len(k) for k in keys])
        main, out = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        for i, (kind, n) in enumerate(zip(kinds, counts)):
            (out if kind else main)[place[ends[i] : ends[i + 1]]] += n.astype(np.int64)
        total = main + out
        stats += [np.count_nonzero(total), total.sum(), np.count_nonzero(main), main.sum()]
        for i, kind in enumerate(kinds):
            own = place[ends[i] : ends[i + 1]]
            done[i] += [small(total[own]), small(main[own]) if kind else np.zeros(0, np.uint8)]
    part = int(pdf["part"].iloc[0])
    rows = [(part, c, k, pack(*d)) for c, k, d in zip(pdf["chunk"], kinds, done)]
    rows.append((part, "", -1, pack(np.array(stats, np.int64))))
    return pd.DataFrame(rows, columns=["part", "chunk", "kind", "blob"])


def looked_up(left: pd.DataFrame, right: pd.DataFrame, parts: int):
    """(chunk, word counts, pair counts) with all training documents, then without the kept-out ones (empty but for kind 1)."""
    c = Chunk(left["blob"].iloc[0], parts)
    got = [unpack(b) for b in right.sort_values("part")["blob"]]
    join = lambda k: np.concatenate([g[k].astype(np.int64) for g in got])
    return c, join(0), join(2), join(1), join(3)


def components(c: Chunk, w: np.ndarray, p: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the context's count, c(v,w)/c(v), c(w)/N) of every token event."""
    context = w[c.before]
    bucket = np.minimum(np.ceil(np.log2(context + 1)).astype(np.int64), BUCKETS - 1)
    return bucket, p[c.pair] / np.maximum(context, 1), w[c.place] / max(1, n)


def em(hist: list[tuple[int, int, int, int]], v: int, rounds: int = 60) -> np.ndarray:
    """(BUCKETS, 3) weights of the pair, word and uniform estimates; rows of hist: bucket, steps of the two logs (-1: zero), events."""
    out = np.full((BUCKETS, 3), np.nan)
    data = np.array(hist, np.int64).reshape(-1, 4)
    value = lambda k: np.where(k < 0, 0.0, 2.0 ** (-(k + 0.5) / STEPS))
    for b in range(BUCKETS):
        own = data[data[:, 0] == b]
        if len(own):
            p = np.stack([value(own[:, 1]), value(own[:, 2]), np.full(len(own), 1 / (v + 1))], 1)
            weight = np.full(3, 1 / 3)
            for _ in range(rounds):
                post = p * weight
                post /= post.sum(1, keepdims=True)
                weight = (post * own[:, 3:]).sum(0) / own[:, 3].sum()
            out[b] = np.maximum(weight, 1e-6) / np.maximum(weight, 1e-6).sum()
    known = [b for b in range(BUCKETS) if not np.isnan(out[b, 0])]
    for b in range(BUCKETS):  # a bucket without events: as the nearest one
        if b not in known:
            out[b] = out[min(known, key=lambda k: abs(k - b))] if known else (1 / 3, 1 / 3, 1 / 3)
    out[0] = (0, out[0, 1] / (out[0, 1] + out[0, 2]), out[0, 2] / (out[0, 1] + out[0, 2]))  # no context count, no pair estimate
    return out


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: int = 7, held: int = 2, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Log10 probability of every whole text under the model, and under add-one unigrams.

    Training documents are those whose crc32(id as text) mod `fold` is not `held`; every DELETED-th
    of them teaches the weights. Null text counts as empty (one end token); a null id as the empty
    text, returned as null. Repeated rows count as often as they occur and get equal scores. Without
    training documents all counts are 0. Other columns are ignored; an empty table gives an empty
    table.
    """
    crc = crc_of_id(F.col(doc_id))
    role = F.when(crc % fold == held, HELD).when(F.floor(crc / fold) % DELETED == 0, KEPT_OUT).otherwise(MAIN)
    slim = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("doc_id"), F.col(text).alias("text"), role.alias("role"))
    chunks = chunked(slim, make_chunk, "text", chunk_bytes)
    parts, rows = key_partitions(chunks), "part int, chunk string, kind int, blob binary"
    got = cut(serve(chunks.mapInPandas(lambda it: ask(it, parts), rows), answer, rows, parts))
    stats = sum((unpack(r["blob"])[0] for r in got.where("kind = -1").collect()), np.zeros(8, np.int64))  # a row per key partition
    v, n, v_main, n_main = (int(x) for x in stats[:4])

    def tally(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c, _, _, w, p = looked_up(left, right, parts)
        bucket, p2, p1 = components(c, w, p, n_main)
        step = lambda x: np.where(x > 0, np.floor(-np.log2(np.where(x > 0, x, 1.0)) * STEPS), -1).astype(np.int64)
        key, k = np.unique((bucket * 1024 + step(p2) + 1) * 1024 + step(p1) + 1, return_counts=True)
        return pd.DataFrame({"b": key >> 20, "s2": (key >> 10) % 1024 - 1, "s1": key % 1024 - 1, "k": k})

    both = lambda kind: (chunks.where(kind).groupBy("chunk", "kind"), got.where(kind).groupBy("chunk", "kind"))
    a, b = both("kind = 1")
    hist = a.cogroup(b).applyInPandas(tally, "b long, s2 long, s1 long, k long").groupBy("b", "s2", "s1").agg(F.sum("k"))
    weights = em([tuple(r) for r in hist.collect()], v_main)  # a bounded grid, whatever the corpus

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c, w, p, _, _ = looked_up(left, right, parts)
        bucket, p2, p1 = components(c, w, p, n)
        at = np.cumsum(c.sizes) - c.sizes
        count = w[c.place]
        own = np.log10(weights[bucket, 0] * p2 + weights[bucket, 1] * p1 + weights[bucket, 2] / (v + 1))
        base = np.log10((count + 1) / (n + v + 1))
        ids = pd.Series(c.ids).astype("Int64").where(c.ids != LOWEST)
        return pd.DataFrame({"doc_id": ids, "held_out": c.roles == HELD, "n_tokens": c.sizes, "n_known": np.add.reduceat((count > 0).astype(np.int64), at), "train_tokens": n, "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(own, at)})

    a, b = both("kind >= 0")
    return a.cogroup(b).applyInPandas(score, SCHEMA)
