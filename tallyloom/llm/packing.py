"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of length l belongs to class m = capacity // l (it fits m times), and every bin of class m
takes exactly m pieces. Documents are cut first: into whole sequences, then into powers of two down
to `cut_floor`, whose classes fill their bins without a gap; only the tail below `cut_floor` leaves
any padding. A worker needs nothing but its offset in each class to fill its bins, so workers do
not wait for one another. The at most capacity * (ln cut_floor + 1) pieces that don't fill a bin of their class
are packed best-fit in one task.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from bisect import bisect_left, insort
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.util import bounded, cut, partitions, slices, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"


@lru_cache(2)
def encoder(path: str, special_as_text: bool = False):
    """A function text -> ids for a .json tokenizer file, as `tokenizers` gives them without added special tokens.

    Byte-level BPE runs in tiktoken if its ranks lie beside the file, which gives the same ids faster. Strings of the file's
    added tokens that occur in a text get their ids, as they do in `tokenizers`, or are ordinary text with `special_as_text`.
    """
    ranks = path.removesuffix(".json") + ".tiktoken"
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) for t in added)
    if os.path.exists(ranks) and plain:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t["content"]: t["id"] for t in added if t["content"]}
        known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
        return known.encode_ordinary if special_as_text else partial(known.encode, allowed_special="all", disallowed_special=())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = special_as_text
    return lambda x: t.encode(x, add_special_tokens=False).ids


def cuts(n: int, capacity: int, floor: int) -> list[int]:
    """Lengths of the pieces of n tokens, in order."""
    out, n = [capacity] * (n // capacity), n % capacity
    step = 1 << (capacity - 1).bit_length() - 1
    while step >= floor:
        if n >= step:
            out.append(step)
            n -= step
        step //= 2
    return out + [n] * (n > 0)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, floor: int, end_id: int, with_ids: bool, doc_id: str, text: str, special_as_text: bool) -> DataFrame:
    def run(it):
        encode = encoder(tokenizer, special_as_text)
        known = {r: cuts(r, capacity, floor) for r in range(capacity)}
        for pdf in it:
            for a, b in slices(pdf["text"].fillna("").tolist(), 1 << 20):  # a bounded number of ids at a time
                rows = []
                for d, x in zip(pdf["doc_id"].iloc[a:b], pdf["text"].iloc[a:b]):
                    ids = np.array([*(encode(x) if isinstance(x, str) else ()), end_id], "<u4")
                    n, at = len(ids), 0
                    for size in [capacity] * (n // capacity) + known[n % capacity]:
                        part = ids[at : at + size]
                        rows.append((d, at, size, zlib.crc32(part.tobytes()), n, part.astype("i4") if with_ids else None))
                        at += size
                out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
                yield out.astype({"doc_id": "Int64"})

    return bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, PIECES)


def best_fit(rows: list[tuple[int, int]], capacity: int) -> dict[int, tuple[int, int]]:
    """{key: (bin, offset)} of (length, key): longest first, each into the fullest bin that takes it."""
    room: list[tuple[int, int]] = []
    out, n = {}, 0
    for size, key in sorted(rows, key=lambda x: (-x[0], x[1])):
        i = bisect_left(room, (size, -1))
        left, b = room.pop(i) if i < len(room) else (capacity, n)
        n = max(n, b + 1)
        out[key] = (b, capacity - left)
        if left > size:
            insort(room, (left - size, b))
    return out


def harmonic_pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, cut_floor: int = 64, end_id: int = 0, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text", special_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length (and ids, if with_ids).

    Null or empty text: the end token alone. A null doc_id is kept as null. A repeated row is packed
    as often as it occurs, with pieces that look alike. A string of an added token in a text gets that token's id, unless
    `special_as_text`. An empty table gives an empty table; columns
    other than the two named ones are ignored. A sequence is padded to `capacity` unless its length
    is a power of two.
    """
    every = pieces(docs, tokenizer, capacity, cut_floor, end_id, with_ids, doc_id, text, special_as_text)
    if with_ids:  # the ids are written once and wait there for their places; a piece's number is final with the table
        whole = written(every.withColumn("__piece", F.monotonically_increasing_id()))
        tall = whole.drop("ids")
    else:
        tall = cut(every.drop("ids"))
    workers = partitions(docs)
    tall = tall.withColumn("__worker", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(workers))).withColumn("__m", F.expr(f"{capacity} div length"))
    count = tall.groupBy("__worker", "__m").agg(F.count("*").alias("__n"))
    before = W.partitionBy("__m").orderBy("__worker").rowsBetween(W.unboundedPreceding, -1)
    count = count.select("__worker", "__m", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    klass = tall.groupBy("__m").agg(F.count("*").alias("__total")).withColumn("__bins", F.expr("__total div __m"))
    # one row per class, at most `capacity` of them
    klass = klass.withColumn("__base", F.coalesce(F.sum("__bins").over(W.orderBy("__m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    klass = klass.withColumn("__all", F.sum("__bins").over(W.partitionBy(F.lit(1))))
    rank = F.row_number().over(W.partitionBy("__worker", "__m").orderBy("doc_id", "start", "ids_crc32"))
    ranked = tall.withColumn("__rank", rank).join(count, ["__worker", "__m"]).join(F.broadcast(klass), "__m")
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__rank") - 1).withColumn("__bin", F.expr("__rank div __m"))
    names = [c for c in tall.columns if c not in ("__worker", "__m")]
    full = ranked.where("__bin < __bins").withColumn("sequence_id", F.col("__base") + F.col("__bin"))
    within = W.partitionBy("sequence_id").orderBy("__rank").rowsBetween(W.unboundedPreceding, -1)
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__m", "__rank"]).reset_index(drop=True)
        where = best_fit(list(zip(pdf["length"], pdf.index)), capacity)
        pdf["sequence_id"] = [int(a) + where[i][0] for i, a in enumerate(pdf["__all"])]
        pdf["offset"] = [where[i][1] for i in range(len(pdf))]
        return pdf[[*names, "sequence_id", "offset"]]

    kinds = dict(tall.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    # fewer than m pieces of each class m
    rest = ranked.where("__bin >= __bins").select(*names, "__m", "__rank", "__all", F.lit(1).alias("__one")).groupBy("__one").applyInPandas(last, schema)
    out = full.select(*names, "sequence_id", "offset").unionByName(rest)
    used = F.sum("length").over(W.partitionBy("sequence_id"))
    out = out.withColumn("__used", used).withColumn("padded_length", F.expr(f"CASE WHEN (__used & (__used - 1)) = 0 THEN __used ELSE {capacity}L END")).drop("__used")
    if not with_ids:
        return out
    # the ids meet their places last and are shuffled once
    return out.join(whole.select("__piece", "ids"), "__piece").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", "ids")
