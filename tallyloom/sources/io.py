"""Sources and sinks: Parquet inside, CSV and JSON at the edge, with overwrite guards and digests."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.identity import content_digest
from tallyloom.functions.text import WS

CSV = {"header": "true", "multiLine": "true", "escape": '"', "encoding": "UTF-8"}
CSV_OUT = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def exists(path: str) -> bool:
    if "://" not in path:
        return Path(path).exists()
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def guard(paths: list[str | Path], force: bool = False) -> None:
    """FileExistsError naming the outputs that exist, unless forced. Paths of another file system (scheme://...) are asked through Spark's."""
    there = [str(p) for p in paths if exists(str(p))]
    if there and not force:
        raise FileExistsError(f"outputs exist: {', '.join(there)}")


def write_atomic(path: str | Path, data: bytes) -> str:
    """Write next to the target, then replace it; returns the SHA-256 of the data."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return hashlib.sha256(data).hexdigest()


def write_json(path: str | Path, value: dict) -> str:
    return write_atomic(path, (json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode())


def read_json(path: str | Path) -> dict:
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise TypeError(f"{path} must hold a JSON object")
    return value


def read_reports(folder: str | Path, names: tuple[str, ...]) -> dict[str, dict]:
    return {n: read_json(Path(folder) / f"{n}.json") for n in names}


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table in at least as many partitions as there are cores: a file of one row group would keep all but one idle. Tables of many splits are left as they are."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_table(df: DataFrame, path: str, force: bool = False, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite" if force else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, force: bool = False) -> None:
    """A folder of CSV files; arrays become |-joined text."""
    flat = df.select(*[F.concat_ws("|", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite" if force else "errorifexists").options(**CSV_OUT).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.options(**CSV).schema(schema).csv(path)


def read_labelled_csv(spark: SparkSession, path: str, numbers: list[str], labels: list[str]) -> DataFrame:
    """A CSV file with a header: the named columns are long, labels double, all others text."""
    raw = spark.read.options(**CSV).csv(path)
    kind = {c: "long" for c in numbers} | {c: "double" for c in labels}
    return raw.select(*[F.col(f"`{c}`").cast(kind.get(c, "string")).alias(c) for c in raw.columns])


def metadata(df: DataFrame, split: str, name: str, revision: str, digest: Callable[[DataFrame], Column] = content_digest) -> DataFrame:
    """(split, rows, digest): content identity of each split; the digest does not depend on row order."""
    body = df.drop(split)
    return df.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("rows"), digest(body).alias("digest")).withColumns({"dataset_name": F.lit(name), "dataset_revision": F.lit(revision)})


def write_metadata(df: DataFrame, split: str, name: str, revision: str, location: str, path: str | Path) -> dict:
    """Where a table lies and what it held, so that it can be opened again as the same table."""
    rows = {r["split"]: {"rows": r["rows"], "digest": r["digest"]} for r in metadata(df, split, name, revision).collect()}  # a row per split
    value = {"dataset_name": name, "resolved_revision": revision, "location": location, "columns": df.columns, "types": dict(df.dtypes), "splits": rows, "total_rows": sum(r["rows"] for r in rows.values()), "written_at": datetime.now(timezone.utc).isoformat()}
    write_json(path, value)
    return value


def open_pinned(spark: SparkSession, path: str | Path, split: str, verify: bool = False) -> DataFrame:
    """The table that a metadata file names; with `verify` its digests are checked. Raises ValueError for blank entries."""
    meta = read_json(path)
    for key in ("dataset_name", "resolved_revision", "location"):
        if not isinstance(meta.get(key), str) or not meta[key].strip():
            raise ValueError(f"{path}: {key} is missing or blank")
    df = spark.read.parquet(meta["location"])
    if verify:
        now = {r["split"]: {"rows": r["rows"], "digest": r["digest"]} for r in metadata(df, split, "", "").collect()}
        if now != meta["splits"]:
            raise ValueError(f"{meta['location']} is not the table that was pinned")
    return df


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(group_no, split, member_id) from a CSV with split and |-joined member_ids; raises if a group has fewer than two."""
    raw = read_csv(spark, path, "split string, member_ids string") if path.endswith("/") else spark.read.options(**CSV).csv(path)
    missing = {"split", "member_ids"} - set(raw.columns)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    ids = F.array_distinct(F.filter(F.transform(F.split("member_ids", r"\|"), lambda x: F.regexp_replace(x, f"^{WS}+|{WS}+$", "")), lambda x: x != ""))
    rows = raw.select("split", ids.alias("ids")).withColumn("group_no", F.monotonically_increasing_id())
    bad = rows.where(F.coalesce(F.size("ids"), F.lit(0)) < 2)
    if not bad.isEmpty():
        raise ValueError(f"{path}: a group has fewer than two members (row {bad.first()['group_no']})")
    return rows.select("group_no", "split", F.explode("ids").alias("member_id"))
