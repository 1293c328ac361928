"""Samples, class balance, chart tables and the rendered summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators.graph import cut
from tallyloom.operators.profile import label_distribution, lengths, mentions
from tallyloom.spec import MISSING, TableSpec

BINS = 50


def aspect_rows(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(aspect, label, id, row, length) with a row per aspect and labelled row; nulls count 4 characters, as text."""
    size = F.length(F.coalesce(F.col(spec.text), F.lit("None"))).cast("long")
    pairs = F.array(*[F.struct(F.lit(a).alias("aspect"), F.col(a).cast("int").alias("label")) for a in spec.labels.columns])
    return df.select(F.col(spec.id).alias("id"), F.col(spec.row).alias("row"), size.alias("length"), F.inline(pairs)).where(F.col("label").isin(list(spec.labels.valid)))


def median_samples(df: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    """For each aspect and label, the row whose length is nearest to the median (ties: id, row), with a preview.

    Medians come from length counts; the nearest row from an aggregate, not a sort.
    """
    rows = aspect_rows(df, spec)
    counts = rows.groupBy("aspect", "label", "length").agg(F.count("*").alias("n"))
    median = counts.groupBy("aspect", "label").agg(F.percentile("length", F.lit(0.5), F.col("n")).alias("median"))
    near = rows.join(F.broadcast(median), ["aspect", "label"])  # a row per aspect and label
    best = near.groupBy("aspect", "label").agg(F.min(F.struct(F.abs(F.col("length") - F.col("median")).alias("d"), "id", "row", "length")).alias("x"))
    best = best.select("aspect", "label", F.col("x.id").alias("id"), F.col("x.row").alias("row"), F.col("x.length").alias("characters"))
    text = df.select(F.col(spec.row).alias("row"), F.col(spec.id).alias("id"), X.preview(F.col(spec.text), 180, strip=True).alias("preview"))
    return text.join(F.broadcast(best), ["row", "id"]).select("aspect", "label", "id", "characters", "preview")


def mixed_samples(df: DataFrame, spec: TableSpec = TableSpec(), most: int = 5, min_mentions: int = 3, min_variety: int = 2) -> DataFrame:
    """The rows with the most mentioned aspects and distinct sentiments."""
    said = F.filter(F.array(*[F.col(a).cast("int") for a in spec.labels.columns]), lambda x: x.isin(list(spec.labels.mention)))
    out = df.withColumns({"__m": mentions(spec), "__v": F.size(F.array_distinct(said))}).where((F.col("__m") >= min_mentions) & (F.col("__v") >= min_variety))
    top = out.orderBy(F.desc("__m"), F.desc("__v"), spec.id, spec.row).limit(most)
    return top.select(F.col(spec.id).alias("id"), F.col("__m").cast("long").alias("mentioned"), F.col("__v").cast("long").alias("variety"), *spec.labels.columns, X.preview(F.col(spec.text), 180, strip=True).alias("preview"))


def product_code_rows(df: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    return df.where(F.col(spec.text).rlike(X.PRODUCT_CODE))


def product_code_samples(df: DataFrame, spec: TableSpec = TableSpec(), most: int = 10) -> DataFrame:
    return product_code_rows(df, spec).orderBy(spec.row).limit(most).select(F.col(spec.id).alias("id"), X.preview(F.col(spec.text), 180, strip=True).alias("preview"))


def class_balance(df: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    """(split, aspect, dominant_label, dominant_count, imbalance): ties go to the least label; imbalance is over the least non-zero count."""
    rows = label_distribution(df, spec).where(F.col("label") != MISSING).withColumn("label", F.col("label").cast("int"))
    best = F.max_by("label", F.struct("count", (-F.col("label")).alias("l")))
    least = F.min(F.when(F.col("count") > 0, F.col("count")))
    out = rows.groupBy("split", "aspect").agg(best.alias("dominant_label"), F.max("count").alias("dominant_count"), least.alias("__least"))
    return out.select("split", "aspect", "dominant_label", "dominant_count", (F.col("dominant_count") / F.col("__least")).alias("imbalance"))


def length_histogram(df: DataFrame, spec: TableSpec = TableSpec(), bins: int = BINS) -> DataFrame:
    """(split, metric, bin, low, high, n) of characters and tokens up to the 99th percentile, in equal bins, empty ones included."""
    sizes = lengths(df, spec)
    h = sizes.select("split", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("characters", "tokens")]))).groupBy("split", "metric", "value").agg(F.count("*").alias("n"))
    h = cut(h)  # read three times
    top = h.groupBy("split", "metric").agg(F.percentile("value", F.lit(0.99), F.col("n")).alias("p99"))
    kept = h.join(top, ["split", "metric"]).where(F.col("value") <= F.col("p99"))
    edge = kept.groupBy("split", "metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    wide = F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    place = F.least(F.floor((F.col("value") - F.col("lo")) * bins / wide), F.lit(bins - 1)).cast("int")
    got = kept.join(edge, ["split", "metric"]).groupBy("split", "metric", place.alias("bin")).agg(F.sum("n").alias("n"))
    grid = edge.select("split", "metric", (F.col("lo") * 1.0).alias("low0"), (wide / bins).alias("step"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(got, ["split", "metric", "bin"], "left")
    return out.select("split", "metric", "bin", (F.col("low0") + F.col("bin") * F.col("step")).alias("low"), (F.col("low0") + (F.col("bin") + 1) * F.col("step")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def label_chart(df: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    """(split, aspect, label, proportion among valid labels): the grouped bars."""
    return label_distribution(df, spec).where(F.col("label") != MISSING).select("split", "aspect", "label", F.col("proportion_among_valid").alias("proportion"))


def duplicate_chart(exact_summary: DataFrame, near_summary: DataFrame) -> DataFrame:
    """(metric, count): the horizontal bars, summed over splits."""
    e = exact_summary.agg(F.sum("duplicate_groups").alias("Exact groups"), F.sum("members").alias("Exact members"))
    n = near_summary.agg(F.sum("high_pairs").alias("Near pairs (high)"), F.sum("review_pairs").alias("Near pairs (review)"), F.sum("clusters").alias("Near clusters"), F.sum("clustered_rows").alias("Clustered rows"))
    long = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("count")) for c in df.columns])))
    return long(e).union(long(n))


def require_aligned(reports: dict[str, dict]) -> None:
    """Raise ValueError unless all reports speak of the same rows: equal split, row count and digest."""
    seen = {(r.get("split"), r.get("rows"), r.get("digest")) for r in reports.values()}
    if len(seen) != 1:
        raise ValueError(f"the reports differ in split, rows or digest: {sorted(map(str, seen))}")


def cell(x) -> str:
    if isinstance(x, float):
        return f"{x:.4f}"
    return "" if x is None else str(x).replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def table(rows: list[dict]) -> str:
    if not rows:
        return "(none)\n"
    head = list(rows[0])
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(cell(r[h]) for h in head) + " |" for r in rows)]) + "\n"


def markdown(title: str, sections: dict[str, list[dict]]) -> str:
    """The small result tables of the analyses as one document."""
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{table(rows)}" for name, rows in sections.items())
