"""Connected components of an edge list."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_EDGES = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share: that of spark.checkpoint.dir. A temporary one, gone with this process, only in local mode; raises RuntimeError elsewhere."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tallyloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of our own, on whatever file system it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's checkpoint folder. Its files go with the DataFrame where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def union_find(edges: list[tuple]) -> list[tuple]:
    """(node, least node of its component) for every node of the edges."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(node, component) for every node of the edges, component being the least node.

    Alternating large-star and small-star rounds, each two aggregations with map-side combine and two
    joins; the number of rounds grows with the logarithm of the longest chain. Up to `driver_edges`
    edges are united on the driver instead. Self-loops count as nodes; edges with a null end are ignored.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)[src]
    edges = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    edges = cut(edges.distinct())
    head = edges.limit(driver_edges + 1).count()
    if head <= driver_edges:
        return spark.createDataFrame(union_find([tuple(r) for r in edges.collect()]), f"node {kind}, component {kind}")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    edges = edges.where("u <> v")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        edges = cut(star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return nodes.join(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
