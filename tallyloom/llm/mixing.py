"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. Tokens are summed by source and leading hash bits; the bucket in
which a source's budget ends is summed again by its next bits, and so on until one hash is left.
What lies below that threshold is taken, so no document is ever sorted, and a larger budget takes a
superset of what a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.util import cut

HASH_BITS, LEVEL_BITS, MAX_REPEATS, DRIVER_SOURCES = 60, 15, 3, 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, text: Column) -> Column:
    """Of the id; of the text where there is none, so that rows without ids don't share a hash."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, __key, source_size, target, __whole, __frac from rows (source, __key, __size): one row per source."""
    s = sizes.groupBy("source", "__key").agg(F.sum("__size").alias("source_size"))
    s = s.withColumn("__no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("__w", (F.col("__no") - 1) % 3 + 1).withColumn("__cap", F.col("source_size") * MAX_REPEATS)
    s = s.withColumn("__ratio", F.col("__cap") / F.col("__w"))
    by = W.orderBy("__ratio", "__no")
    s = s.withColumn("__rank", F.row_number().over(by))
    s = s.withColumn("__capped", F.coalesce(F.sum("__cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("__rest", F.sum("__w").over(by.rowsBetween(0, W.unboundedFollowing)))
    every = W.partitionBy(F.lit(1))
    s = s.withColumn("__level", (F.sum("source_size").over(every) - F.col("__capped")) / F.col("__rest"))
    fits = F.when(F.col("__ratio") >= F.col("__level"), F.col("__rank"))
    s = s.withColumn("__k", F.min(fits).over(every))
    s = s.withColumn("__at", F.min(F.when(F.col("__rank") == F.col("__k"), F.col("__level"))).over(every))
    s = s.withColumn("target", F.when(F.col("__rank") < F.col("__k"), F.col("__cap").cast("double")).otherwise(F.col("__at") * F.col("__w")))
    s = s.withColumn("__whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))).otherwise(F.lit(0)).cast("long"))
    return s.select("source", "__key", "source_size", "target", "__whole", (F.col("target") - F.col("__whole") * F.col("source_size")).alias("__frac"))


def small_side(table: DataFrame, few: bool) -> DataFrame:
    """A table of a row of some 50 bytes per source, broadcast if they were counted to be few."""
    return F.broadcast(table) if few else table


def thresholds(sizes: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """targets with __edge: documents whose hash is below it are taken once more than __whole times.

    The first level sums all rows before it meets the targets; later ones read only the rows of the edge's buckets. So the
    row table is never shuffled, however few the sources.
    """
    edge = targets.select("__key", F.col("__frac").alias("__left"), F.lit(0).cast("long").alias("__prefix"))
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        own, at = sizes.select("__key", F.shiftright("__h", shift).alias("__b"), "__size"), edge.select("__key", "__left", "__prefix")
        if level:
            own = own.withColumn("__prefix", F.shiftright("__b", LEVEL_BITS)).join(small_side(at, few), ["__key", "__prefix"])
            hist = own.groupBy("__key", "__left", "__b").agg(F.sum("__size").alias("__sum"))
        else:
            hist = own.groupBy("__key", "__b").agg(F.sum("__size").alias("__sum")).join(small_side(at.drop("__prefix"), few), "__key")
        upto = W.partitionBy("__key").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # at most 2^LEVEL_BITS rows
        hist = hist.withColumn("__before", F.coalesce(F.sum("__sum").over(upto), F.lit(0))).where("__before <= __left")
        last = hist.groupBy("__key", "__left").agg(F.max_by(F.struct("__b", "__before", "__sum"), "__b").alias("__x"))
        edge = last.select("__key", (F.col("__left") - F.col("__x.__before")).alias("__left"), F.col("__x.__b").alias("__prefix"), F.col("__x.__sum").alias("__sum"))
    # the document on the edge is taken if that brings the sum nearer
    edge = edge.select("__key", (F.col("__prefix") + F.when(F.col("__sum") <= 2 * F.col("__left"), 1).otherwise(0)).alias("__edge"))
    return targets.join(edge, "__key", "left")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes; taken / size is how often the document is used).

    Size is the number of words. Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the sum of all
    sizes; a target stops at three times its source's size and the excess goes to the others by weight.
    Null or empty text has size 0 and takes 0; a null source is a source of its own; a row without an id is
    hashed by its text. Rows with one id share a hash: they are taken together or not at all. Columns
    of docs keep their values; one named like a result column is replaced by it. An empty table gives
    an empty table. Equal input gives an equal mix.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))
    sizes = cut(docs.select(F.col(source).alias("source"), key.alias("__key"), doc_hash(F.col(doc_id), F.col(text)).alias("__h"), n_words(F.col(text)).alias("__size")))
    targets = cut(source_targets(sizes))
    few = targets.count() <= DRIVER_SOURCES
    table = cut(thresholds(sizes, targets, few))
    table = table.select("__key", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "__whole", "__edge")
    out = docs.withColumns({"__key": key, "__h": doc_hash(F.col(doc_id), F.col(text)), "__size": n_words(F.col(text))}).join(small_side(table, few), "__key", "left")
    times = F.col("__whole") + F.when(F.col("__h") < F.col("__edge"), 1).otherwise(0)
    out = out.withColumns({"size": F.col("__size"), "source_size": F.col("__source_size"), "target": F.col("__target"), "taken": F.col("__size") * times})
    return out.drop("__key", "__h", "__size", "__source_size", "__target", "__whole", "__edge")


def copies(mixed: DataFrame) -> DataFrame:
    """Each row as often as the mix uses it; rows that it does not take go, and so do empty ones."""
    return mixed.where("taken > 0").withColumn("__copy", F.explode(F.expr("sequence(1, int(taken div size))"))).drop("__copy", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) AS no FROM s0),
s2 AS (SELECT *, (no - 1) % 3 + 1 AS w, source_size * 3 AS cap, (source_size * 3)::DOUBLE / ((no - 1) % 3 + 1) AS ratio FROM s1),
s3 AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ratio, no) AS rnk,
         COALESCE(SUM(cap) OVER (ORDER BY ratio, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
         SUM(w) OVER (ORDER BY ratio, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest,
         SUM(source_size) OVER ()::BIGINT AS total FROM s2),
s4 AS (SELECT *, (total - capped)::DOUBLE / rest AS lvl FROM s3),
k AS (SELECT rnk AS krnk, lvl AS klvl FROM s4 WHERE ratio >= lvl ORDER BY rnk LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN rnk < krnk THEN cap::DOUBLE ELSE klvl * w END AS target FROM s4, k),
u AS (SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT d.*, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size AS frac,
        SUM(size) OVER (PARTITION BY d.source, h)::BIGINT AS own,
        SUM(size) OVER (PARTITION BY d.source ORDER BY h)::BIGINT AS upto
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto - own <= frac AND own <= 2 * (frac - (upto - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM g
"""
