"""Lempel-Ziv phrase fingerprints.

A text's bytes are parsed into LZ78 phrases (each the longest known phrase and one more byte). The
set of phrases is hashed and reduced to a one-permutation minimum-hash signature; the share of equal
signature slots estimates the Jaccard similarity of two phrase sets, which behaves like a
compression distance.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.util import bounded, mix, partitions

SLOTS, EMPTY = 128, 0xFFFF
MASK = (1 << 64) - 1
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Parse:
    """LZ78 over bytes that can be rewound: phrases are numbered in the order in which they arise."""

    def __init__(self) -> None:
        self.next: dict[int, int] = {}
        self.keys: list[int] = []
        self.hash: list[int] = [0x51ED270B]

    def feed(self, raw: bytes, node: int = 0) -> int:
        """Parse on from a node; returns the node of the unfinished phrase."""
        table, keys, hashes = self.next, self.keys, self.hash
        get = table.get
        for c in raw:
            key = node << 8 | c
            node = get(key)
            if node is None:
                keys.append(key)
                table[key] = len(keys)
                hashes.append((hashes[key >> 8] * 0x100000001B3 + c + 1) & MASK)
                node = 0
        return node

    def rewind(self, size: int) -> None:
        for key in self.keys[size:]:
            del self.next[key]
        del self.keys[size:], self.hash[size + 1 :]


def signature(hashes: list[int], tail: int) -> np.ndarray:
    """16 bits of the least hash in each of SLOTS slots; `tail` is the hash of the unfinished phrase, 0 if none."""
    h = mix(np.array(hashes[1:] + [tail] * (tail > 0), np.uint64))
    out = np.full(SLOTS, EMPTY, np.uint64)
    slot, value = h >> np.uint64(57), h << np.uint64(7) >> np.uint64(7)
    least = np.full(SLOTS, MASK, np.uint64)
    np.minimum.at(least, slot.astype(np.int64), value)
    seen = least != MASK
    out[seen] = mix(least[seen]) % np.uint64(EMPTY)
    return out


def fingerprints(raw: bytes, keep: int, more: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of raw and of raw[:keep] + more, parsing what they share once."""
    p = Parse()
    node = p.feed(raw[:keep])
    size = len(p.keys)
    end = p.feed(raw[keep:], node)
    own = signature(p.hash, p.hash[end] if end else 0)
    if more == raw[keep:]:
        return own, own
    p.rewind(size)
    end = p.feed(more, node)
    return own, signature(p.hash, p.hash[end] if end else 0)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots among those that either text fills; 1 for two empty texts."""
    used = (a != EMPTY) | (b != EMPTY)
    return float(((a == b) & used).sum() / used.sum()) if used.any() else 1.0


def as_text(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u2").astype(np.uint64)


def fingerprint(texts) -> list[str]:
    out = []
    for x in texts:
        raw = x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b""
        out.append(as_text(fingerprints(raw, len(raw), b"")[0]))
    return out


LOWEST = -(1 << 63)


BUCKET_BYTES = 32 << 20


class Ranges:
    """Ranges of (id, text hash), in descending order, of about equal numbers of rows: an id that holds several quantiles is split by hash."""

    def __init__(self, quantiles: list[int]) -> None:
        times = sorted(Counter(quantiles).items())
        self.id = np.array([v for v, k in times for _ in range(k)], np.int64)
        self.hash = np.array([LOWEST + (1 << 64) // k * i for _, k in times for i in range(k)], np.int64)
        self.split = [v for v, k in times if k > 1]

    def __len__(self) -> int:
        return len(self.id) + 1

    def number(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        upto = np.searchsorted(self.id, ids, "right")  # bounds (v, h) with v <= id; where v = id, those with h <= hash
        for v in self.split:
            own = ids == v
            if own.any():
                upto[own] = np.searchsorted(self.id, v) + np.searchsorted(self.hash[self.id == v], hashes[own], "right")
        return (len(self.id) - upto).astype(np.int32)


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (__bucket, __guest, __id, __h, doc_id, text) such that each document and its successor by descending doc_id meet in one bucket, and the number of buckets.

    Buckets are ranges with approximate quantiles as bounds; the first document of a bucket is also sent
    to the bucket before it (the first bucket's to the last), as a guest that closes it. Only the bounds
    and one key per bucket reach the driver.
    """
    docs = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(LOWEST)), "__h": F.xxhash64("text")})
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(2 * partitions(docs), -(-size // BUCKET_BYTES))
    keys = docs.select("__id", "__h")
    ranges = Ranges(list(map(int, keys.approxQuantile("__id", [i / n for i in range(1, n)], 0.1 / n))))

    @F.pandas_udf("int")
    def number(x: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(ranges.number(x.to_numpy(np.int64), h.to_numpy(np.int64)))

    heads = {b: tuple(k) for b, k in keys.groupBy(number("__id", "__h").alias("b")).agg(F.max(F.struct("__id", "__h"))).collect()}
    order = sorted(heads)
    before = {heads[b]: order[i - 1] for i, b in enumerate(order)}

    @F.pandas_udf("array<int>")
    def places(x: pd.Series, h: pd.Series) -> pd.Series:
        own = ranges.number(x.to_numpy(np.int64), h.to_numpy(np.int64))
        return pd.Series([[b, before[k]] if k in before else [b] for k, b in zip(zip(x, h), own.tolist())])

    rows = docs.select("__id", "__h", "doc_id", "text", F.posexplode(places("__id", "__h")).alias("__guest", "__bucket"))
    return rows, len(ranges)


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text: its last floor(n_chars / 3) code points replaced by as many first ones of the next document.

    The next document is the one after it by descending doc_id (rows of one id by a hash of the text;
    null ids last), the first one after the last. Null text counts as empty. An empty text's fingerprint has no
    slot filled; two such are alike by 1. Equal texts have equal fingerprints. A single row is its
    own next document. An empty table gives an empty table; other columns are ignored.
    """
    docs = bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, n = with_next(docs)
    rows = rows.repartitionById(n, F.col("__bucket")).sortWithinPartitions("__bucket", "__guest", F.col("__id").desc(), F.col("__h").desc(), "text")

    def close(held, nxt: str):
        """(row but for near_next, own signature) of a document whose successor's text is known."""
        d, x = held
        keep, fill = x[: len(x) - len(x) // 3], nxt[: len(x) // 3]
        a, b = keep.encode("utf-8", "surrogatepass"), fill.encode("utf-8", "surrogatepass")
        raw = x.encode("utf-8", "surrogatepass")
        own, edited = fingerprints(raw, len(a), b)
        return [d, len(x), hashlib.sha256(a + b).hexdigest(), as_text(own), as_text(edited), likeness(own, edited)], own

    def run(it):
        at, held, waiting = None, None, None  # bucket; (id, text) without successor; closed row without its successor's signature
        for pdf in it:
            out = []
            for bucket, guest, d, x in zip(pdf["__bucket"], pdf["__guest"], pdf["doc_id"], pdf["text"]):
                if bucket != at:
                    at, held, waiting = bucket, None, None
                elif held is None:
                    continue  # a second guest
                if held is not None:
                    row, own = close(held, x)
                    if waiting is not None:
                        out.append([*waiting[0], likeness(waiting[1], own)])
                    waiting, held = (row, own), None
                if guest:
                    raw = x.encode("utf-8", "surrogatepass")
                    out.append([*waiting[0], likeness(waiting[1], fingerprints(raw, len(raw), b"")[0])])
                    waiting = None
                else:
                    held = (d, x)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    return rows.mapInPandas(run, SCHEMA)
