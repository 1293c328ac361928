"""Shared plumbing: lineage cuts, batch slicing, vectorised words, and the chunk exchange.

The chunk exchange is how the corpus-wide operators look up facts about their keys without one
shuffled row per key: documents are grouped into chunks of some megabytes, every chunk asks each
key partition once for its distinct keys in one binary row, and the partition answers in one row.
A key therefore reaches its partition at most once per chunk, however hot it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.graph import cut, shared_folder  # noqa: F401

SLICE_BYTES, KEY_BYTES = 2 << 20, 32 << 20
U64 = np.uint64


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by bytes: ten thousand rows may hold long texts. A setting of the session's own stays."""
    spark = df.sparkSession
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(size))
    return df


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the session's checkpoint folder: its columns are read apart, and its rows are final."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def key_partitions(chunks: DataFrame, share: int = KEY_BYTES) -> int:
    """As many key partitions as give each some `share` bytes of the chunks, whatever the session's setting; that setting at least."""
    size = chunks.agg(F.sum(F.length("blob"))).first()[0] or 0
    return max(partitions(chunks), -(-size // share))


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def encoded(texts) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in texts]


def slices(raw: list[bytes], limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Consecutive (from, to) of about `limit` bytes; a longer text stands alone and whole."""
    at, size = 0, 0
    for i, x in enumerate(raw):
        if i > at and (size + len(x) > limit or i - at >= rows):
            yield at, i
            at, size = i, 0
        size += len(x)
    if raw:
        yield at, len(raw)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(max(1, n), base, dtype=U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def words(raw: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, words of each text, code points of each text's words), words being runs of other than ASCII white space."""
    counts, chars = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    if lower:
        buf = _LOWER[buf]
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, U64), counts, chars
    first = np.cumsum([0] + [len(x) + 1 for x in raw[:-1]])
    counts = np.bincount(np.searchsorted(first, starts, "right") - 1, minlength=len(raw))
    lead = np.concatenate([[0], np.cumsum(inside & ((buf & 0xC0) != 0x80))])
    chars = lead[np.append(first[1:], len(buf))] - lead[first]
    size = ends - starts
    at = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) - np.repeat(at, size)
    h = np.add.reduceat((buf[inside].astype(U64) + U64(1)) * powers(0x9E3779B97F4A7C15, int(size.max()))[pos], at)
    return mix(h + size.astype(U64)), counts, chars


# The chunk exchange.

CHUNK_SCHEMA = "chunk string, kind int, blob binary"
KEY_SCHEMA = "part int, chunk string, blob binary"


def pack(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays (or bytes) as one block; each byte plane of an array is compressed for itself, as only its upper ones are regular."""
    z, out = zstandard.ZstdCompressor(level=level), [bytes([len(arrays)])]
    for a in arrays:
        kind, n = (b"B", 1) if isinstance(a, bytes) else (np.dtype(a.dtype).str.encode(), a.dtype.itemsize)
        planes = [a] if isinstance(a, bytes) else np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, n).T)
        out.append(kind.ljust(4))
        for p in planes:
            plain = bytes(p)
            small = z.compress(plain)
            best = small if len(small) < len(plain) else plain
            out += [len(plain).to_bytes(8, "little"), len(best).to_bytes(8, "little"), best]
    return b"".join(out)


def unpack(blob: bytes) -> list:
    blob, at, out, z = bytes(blob), 1, [], zstandard.ZstdDecompressor()
    for _ in range(blob[0]):
        kind = blob[at : at + 4].strip()
        at += 4
        planes = []
        for _ in range(1 if kind == b"B" else np.dtype(kind.decode()).itemsize):
            full, size = (int.from_bytes(blob[at + k : at + k + 8], "little") for k in (0, 8))
            p = blob[at + 16 : at + 16 + size]
            planes.append(p if size == full else z.decompress(p))
            at += 16 + size
        if kind == b"B":
            out.append(planes[0])
        else:
            rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
            out.append(np.ascontiguousarray(rows.T).view(np.dtype(kind.decode())).reshape(-1))
    return out


def chunked(df: DataFrame, make: Callable[[pd.DataFrame], list[tuple[int, bytes]]], text: str, limit: int) -> DataFrame:
    """Rows (chunk, kind, blob) of make(rows of about `limit` bytes of text), checkpointed so that a chunk's name is final."""

    def run(it):
        n, held, size = 0, [], 0

        def emit():
            nonlocal n
            rows = pd.concat(held, ignore_index=True)
            name = f"{TaskContext.get().partitionId()}-{n}"
            n += 1
            return pd.DataFrame([(name, k, b) for k, b in make(rows)], columns=["chunk", "kind", "blob"])

        for pdf in it:
            lengths = [len(x) * 2 if isinstance(x, str) else 0 for x in pdf[text]]
            at = 0
            for i, x in enumerate(lengths):
                if size and size + x > limit:
                    held.append(pdf.iloc[at:i])
                    yield emit()
                    held, size, at = [], 0, i
                size += x + 1
            held.append(pdf.iloc[at:])
        if held and sum(map(len, held)):
            yield emit()

    return cut(bounded(df).mapInPandas(run, CHUNK_SCHEMA))


def serve(asks: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, parts: int) -> DataFrame:
    """answer() gets all the asks of one key partition, each of which is a task of its own (no two fall together by a hash)."""
    return asks.repartitionById(parts, F.col("part")).groupBy("part").applyInPandas(answer, schema)
