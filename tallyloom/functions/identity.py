"""Stable ids: SHA-256 over canonical JSON with sorted keys."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "v1"


def review_id(source_split: Column, source_id: Column, dataset: str, revision: str) -> Column:
    body = F.to_json(F.struct(F.lit(dataset).alias("dataset_name"), F.lit(revision).alias("dataset_revision"), F.lit(SCHEMA_VERSION).alias("schema_version"), source_id.cast("string").alias("source_id"), source_split.alias("source_split")))
    return F.concat(F.lit("review_"), F.sha2(body, 256))


def group_id(sorted_members: Column) -> Column:
    body = F.to_json(F.struct(sorted_members.alias("member_review_ids"), F.lit(SCHEMA_VERSION).alias("schema_version")))
    return F.concat(F.lit("group_"), F.sha2(body, 256))


def digests(rows: DataFrame, group: list[str], order: list[str], item: Callable[[str], str], head: str, joint: str, tail: str) -> DataFrame:
    """(group columns, digest): SHA-256 of head, the group's last order column joined in order, tail.

    The rows of a group are sorted, which may spill, and run through the hash one by one: no group is
    ever gathered in memory, however large it is. Rows are spread by a hash of their own: a repartition by the group
    itself is dropped where a join below has the same partitioning, which adaptive execution may then undo, and a group
    that lies in several partitions has several digests.
    """
    kinds, last = dict(rows.dtypes), order[-1]
    own = rows.select(*group, *[c for c in order if c not in group]).withColumn("__at", F.xxhash64(*group))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.repartition(n, "__at").sortWithinPartitions(*group, *order).drop("__at")

    def run(it):
        at, h = None, None
        for pdf in it:
            out = []
            for key, x in zip(zip(*[pdf[g] for g in group]), pdf[last]):
                if key != at:
                    if h is not None:
                        h.update(tail.encode())
                        out.append((*at, h.hexdigest()))
                    at, h = key, hashlib.sha256(head.encode())
                else:
                    h.update(joint.encode())
                h.update(item(str(x)).encode())
            yield pd.DataFrame(out, columns=[*group, "digest"])
        if h is not None:
            h.update(tail.encode())
            yield pd.DataFrame([(*at, h.hexdigest())], columns=[*group, "digest"])

    return own.mapInPandas(run, ", ".join(f"{g} {kinds[g]}" for g in group) + ", digest string")


def group_ids(members: DataFrame, root: str, review_id: str) -> DataFrame:
    """(root, group_id), as group_id() gives it for the sorted members, without gathering them."""
    quoted = lambda x: json.dumps(x, ensure_ascii=False)
    out = digests(members, [root], [review_id], quoted, '{"member_review_ids":[', ",", f'],"schema_version":"{SCHEMA_VERSION}"}}')
    return out.select(root, F.concat(F.lit("group_"), F.col("digest")).alias("group_id"))


def cluster_ids(members: DataFrame, group: list[str], row: str, item: str) -> DataFrame:
    """(group columns, cluster_id): hash of the |-joined ids in row order."""
    return digests(members, group, [row, item], str, "", "|", "").withColumnRenamed("digest", "cluster_id")


def duplicate_group_id(norm: Column) -> Column:
    return F.sha2(norm, 256)


def pair_id(first_group: Column, second_group: Column) -> Column:
    """Of two texts' duplicate_group_id, the earlier row's first."""
    return F.sha2(F.concat_ws(":", first_group, second_group), 256)


def order_key(group: Column, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(SCHEMA_VERSION), F.lit(str(seed)), group), 256)


def require_identity(df: DataFrame, dataset: str, revision: str, split: str, source_id: str) -> None:
    """Raise ValueError for blank names, null or blank splits and ids, and ids that are neither integral nor text."""
    if not dataset.strip() or not revision.strip():
        raise ValueError("dataset name and revision must not be blank")
    kind = dict(df.dtypes)[source_id]
    if kind not in ("tinyint", "smallint", "int", "bigint", "string"):
        raise ValueError(f"{source_id} must be an integer or text column, not {kind}")
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    bad = df.agg(F.count_if(blank(split)).alias("s"), F.count_if(blank(source_id)).alias("i")).first()
    if bad.s or bad.i:
        raise ValueError(f"{bad.s} blank splits, {bad.i} blank ids")


def require_unique(df: DataFrame, key: str, identity: list[str]) -> None:
    """Raise ValueError if an id occurs twice: a duplicate if the identities agree, a collision if they don't."""
    worst = df.groupBy(key).agg(F.count("*").alias("__n"), F.count_distinct(*identity).alias("__k")).where("__n > 1").orderBy(F.desc("__k"), key).first()
    if worst is not None:
        raise ValueError(f"{'collision of' if worst["__k"] > 1 else 'duplicate'} {key} {worst[key]}")


def sha_digest(df: DataFrame) -> Column:
    """content_digest() by SHA-256 of the values as text, which SQL can reproduce."""
    one = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns]), 256)
    return F.sum(F.conv(F.substring(one, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")


def content_digest(df: DataFrame) -> Column:
    """An order-insensitive digest of rows for use in agg(): equal rows add up rather than cancel."""
    return F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")
