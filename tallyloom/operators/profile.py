"""Label and text profiles, per source split, as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators.graph import cut
from tallyloom.operators.validate import require, non_integer, out_of_range
from tallyloom.spec import MISSING, PERCENTILES, TableSpec

METRICS = ("characters", "tokens", "lines")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(0.0))


def require_labels(df: DataFrame, spec: TableSpec) -> None:
    require(df, {f"invalid {c}": non_integer(F.col(c)) | out_of_range(F.col(c), spec.labels.valid) for c in spec.labels.columns})


def label_distribution(df: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    """(split, aspect, label, count, valid_count, total, proportions over total and over valid): one conditional aggregate, so zero counts stay."""
    s = spec.labels
    cells = [(a, str(v), F.count_if(F.col(a) == v)) for a in s.columns for v in s.valid] + [(a, MISSING, F.count_if(F.col(a).isNull())) for a in s.columns]
    wide = df.groupBy(F.col(spec.split).alias("split")).agg(F.count("*").alias("total"), *[c.alias(f"__{i}") for i, (_, _, c) in enumerate(cells)], *[F.count_if(F.col(a).isin(list(s.valid))).alias(f"__v_{a}") for a in s.columns])
    long = wide.select("split", "total", F.inline(F.array(*[F.struct(F.lit(a).alias("aspect"), F.lit(v).alias("label"), F.col(f"__{i}").alias("count"), F.col(f"__v_{a}").alias("valid_count")) for i, (a, v, _) in enumerate(cells)])))
    of_valid = F.when(F.col("label") == MISSING, F.lit(None)).otherwise(ratio(F.col("count"), F.col("valid_count")))
    return long.select("split", "aspect", "label", "count", "valid_count", "total", ratio(F.col("count"), F.col("total")).alias("proportion"), of_valid.cast("double").alias("proportion_among_valid"))


def label_summary(df: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    """(split, aspect, total, valid_count, missing_count, mentioned_count, mentioned_proportion, mentioned_among_valid)."""
    s = spec.labels
    wide = df.groupBy(F.col(spec.split).alias("split")).agg(F.count("*").alias("total"), *[x for a in s.columns for x in (F.count_if(F.col(a).isin(list(s.valid))).alias(f"v_{a}"), F.count_if(F.col(a).isNull()).alias(f"n_{a}"), F.count_if(F.col(a).isin(list(s.mention))).alias(f"m_{a}"))])
    long = wide.select("split", "total", F.inline(F.array(*[F.struct(F.lit(a).alias("aspect"), F.col(f"v_{a}").alias("valid_count"), F.col(f"n_{a}").alias("missing_count"), F.col(f"m_{a}").alias("mentioned_count")) for a in s.columns])))
    m = F.col("mentioned_count")
    return long.withColumn("mentioned_proportion", ratio(m, F.col("total"))).withColumn("mentioned_among_valid", ratio(m, F.col("valid_count")))


def mentions(spec: TableSpec) -> Column:
    """How many aspects a row mentions; a null is no mention."""
    return sum((F.when(F.col(a).isin(list(spec.labels.mention)), 1).otherwise(0) for a in spec.labels.columns), F.lit(0))


def mentioned_aspects(df: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    """(split, mentioned, rows, proportion, mean_mentioned, rows_with_missing) for 0 up to all aspects, zero counts included."""
    n = len(spec.labels.columns)
    any_null = F.exists(F.array(*[F.col(a).isNull() for a in spec.labels.columns]), lambda x: x)
    wide = df.select(F.col(spec.split).alias("split"), mentions(spec).alias("__m"), any_null.alias("__x")).groupBy("split").agg(
        F.count("*").alias("__n"), F.avg("__m").alias("mean_mentioned"), F.count_if("__x").alias("rows_with_missing"), *[F.count_if(F.col("__m") == i).alias(f"__{i}") for i in range(n + 1)]
    )
    long = wide.select("split", "__n", "mean_mentioned", "rows_with_missing", F.posexplode(F.array(*[F.col(f"__{i}") for i in range(n + 1)])).alias("mentioned", "rows"))
    return long.select("split", "mentioned", "rows", ratio(F.col("rows"), F.col("__n")).alias("proportion"), "mean_mentioned", "rows_with_missing")


def usable(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows whose text is neither null nor blank."""
    return df.where(F.col(spec.text).isNotNull() & ~X.is_blank(F.col(spec.text)))


def text_availability(df: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    t = F.col(spec.text)
    return df.groupBy(F.col(spec.split).alias("split")).agg(F.count("*").alias("total"), F.count_if(t.isNull()).alias("null_text"), F.count_if(X.is_blank(t)).alias("empty_text"), F.count_if(t.isNotNull() & ~X.is_blank(t)).alias("profiled"))


def lengths(df: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    """(split, id, row, characters, tokens, lines) of usable rows; text itself stops here."""
    t = F.col(spec.text)
    out = usable(df, spec).select(F.col(spec.split).alias("split"), F.col(spec.id).alias("id"), F.col(spec.row).alias("row"), X.char_count(t).alias("characters"), X.sizes_of(t).alias("__s"))
    return out.select("split", "id", "row", "characters", F.col("__s.tokens").alias("tokens"), F.col("__s.lines").alias("lines"))


def unpivoted(sizes: DataFrame) -> DataFrame:
    return sizes.select("split", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])))


def histogram(sizes: DataFrame) -> DataFrame:
    """(split, metric, value, n): lengths repeat, so every exact statistic comes from this small table and the texts are read once."""
    return unpivoted(sizes).groupBy("split", "metric", "value").agg(F.count("*").alias("n"))


def length_percentiles(sizes: DataFrame) -> DataFrame:
    """(split, metric, percentile, value): exact, linear interpolation, from value counts."""
    q = F.percentile("value", F.array(*[F.lit(p) for p in PERCENTILES]), F.col("n")).alias("q")
    names = [f"p{round(p * 100):02d}" for p in PERCENTILES]
    wide = histogram(sizes).groupBy("split", "metric").agg(q)
    return wide.select("split", "metric", F.inline(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("percentile"), F.col("q").alias("value"))))


def length_statistics(sizes: DataFrame) -> DataFrame:
    """minimum, maximum, mean, population deviation, IQR, fences and strict outlier counts per split and metric."""
    h = cut(histogram(sizes))
    n, v = F.sum("n"), F.col("value").cast("double")
    mean = F.sum(v * F.col("n")) / n
    stats = h.groupBy("split", "metric").agg(n.alias("rows"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), mean.alias("mean"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("q"))
    stats = stats.withColumn("iqr", F.col("q")[1] - F.col("q")[0])
    stats = stats.withColumn("lower_fence", F.greatest(F.lit(0.0), F.col("q")[0] - 1.5 * F.col("iqr"))).withColumn("upper_fence", F.col("q")[1] + 1.5 * F.col("iqr"))
    keys = ["rows", "minimum", "maximum", "mean", "iqr", "lower_fence", "upper_fence"]
    again = h.join(stats.drop("q"), ["split", "metric"]).groupBy("split", "metric", *keys).agg(
        F.sqrt(F.sum((F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean")) * F.col("n")) / F.col("rows")).alias("standard_deviation"),
        F.coalesce(F.sum(F.when(F.col("value") < F.col("lower_fence"), F.col("n"))), F.lit(0)).alias("lower_outliers"),
        F.coalesce(F.sum(F.when(F.col("value") > F.col("upper_fence"), F.col("n"))), F.lit(0)).alias("upper_outliers"),
    )
    return again


def threshold_counts(sizes: DataFrame, short_chars: int = 10, short_tokens: int = 3) -> DataFrame:
    """Rows of at most so many characters and tokens, and of at least the 99th percentile (inclusive)."""
    h = cut(histogram(sizes))
    p = h.groupBy("split", "metric").agg(F.percentile("value", F.lit(0.99), F.col("n")).alias("p99"))
    hit = lambda m, test: F.coalesce(F.sum(F.when((F.col("metric") == m) & test, F.col("n"))), F.lit(0))
    return h.join(p, ["split", "metric"]).groupBy("split").agg(
        hit("characters", F.col("value") <= short_chars).alias("short_characters"), hit("tokens", F.col("value") <= short_tokens).alias("short_tokens"),
        hit("characters", F.col("value") >= F.col("p99")).alias("long_characters"), hit("tokens", F.col("value") >= F.col("p99")).alias("long_tokens"),
    )


def longest(df: DataFrame, spec: TableSpec = TableSpec(), most: int = 10) -> DataFrame:
    """The longest rows of each split: characters, tokens, then row order; previews are looked up for those alone."""
    rank = F.row_number().over(W.partitionBy("split").orderBy(F.desc("characters"), F.desc("tokens"), "row"))
    top = lengths(df, spec).withColumn("rank", rank).where(F.col("rank") <= most)
    text = df.select(F.col(spec.split).alias("split"), F.col(spec.row).alias("row"), X.preview(F.col(spec.text)).alias("preview"))
    return text.join(F.broadcast(top), ["split", "row"]).select("split", "rank", "id", "row", "characters", "tokens", "lines", "preview")


def pattern_signals(df: DataFrame, spec: TableSpec = TableSpec(), patterns: dict[str, str] = X.PATTERNS) -> DataFrame:
    """(split, pattern, rows, proportion, occurrences) per pattern over usable rows; zero rows included."""
    counted = usable(df, spec).select(F.col(spec.split).alias("split"), F.col(spec.text).alias("__t"), X.pattern_counts_of(F.col(spec.text)).alias("__c"))
    known = lambda n, p: X.PATTERNS.get(n) == p
    hits = counted.select("split", *[(F.col(f"__c.{n}") if known(n, p) else X.count_of(F.col("__t"), p)).alias(n) for n, p in patterns.items()])
    wide = hits.groupBy("split").agg(F.count("*").alias("__n"), *[x for n in patterns for x in (F.count_if(F.col(n) > 0).alias(f"r_{n}"), F.sum(n).alias(f"o_{n}"))])
    long = wide.select("split", "__n", F.inline(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(f"r_{n}").alias("rows"), F.col(f"o_{n}").alias("occurrences")) for n in patterns])))
    return long.select("split", "pattern", "rows", ratio(F.col("rows"), F.col("__n")).alias("proportion"), "occurrences")


def even_sample(df: DataFrame, k: int, row: str = "row_index") -> DataFrame:
    """k rows at even steps of the order of `row`, all rows if there are no more; raises ValueError for k < 1.

    Positions are ranks, whatever gaps the column has: its sorted values are numbered by the counts of the partitions, of
    which one number each reaches the driver. Rows that share a value come together.
    """
    if k < 1:
        raise ValueError("the sample needs at least one row")
    order = cut(df.select(F.col(row).alias("__row")).orderBy("__row")).select("__row", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    sizes = sorted(order.groupBy("__part").count().collect())  # a row per partition
    n = sum(c for _, c in sizes)
    if k >= n:
        return df
    places, start, wanted = sorted({min(int(i * (n / k)), n - 1) for i in range(k)}), 0, []
    for part, c in sizes:
        wanted += [(part, p - start) for p in places if start <= p < start + c]
        start += c
    picked = order.join(F.broadcast(df.sparkSession.createDataFrame(wanted, "__part int, __at long")), ["__part", "__at"]).select("__row").distinct()
    return df.join(F.broadcast(picked), F.col(row) == F.col("__row"), "left_semi")  # k values
