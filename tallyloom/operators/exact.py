"""Exact duplicates: raw and normalised groups within a source split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators.graph import cut
from tallyloom.operators.validate import require
from tallyloom.spec import TableSpec


def require_text(df: DataFrame, spec: TableSpec) -> None:
    require(df, {"null text": F.col(spec.text).isNull()})


def spread(columns: tuple[str, ...]) -> list[Column]:
    """Aggregates from which label consistency follows without distinct counts: minimum, maximum and non-null count."""
    return [x for a in columns for x in (F.min(a).alias(f"__lo_{a}"), F.max(a).alias(f"__hi_{a}"), F.count(a).alias(f"__n_{a}"))]


def from_spread(columns: tuple[str, ...], n: Column) -> tuple[Column, Column]:
    """(conflicting, mixed-missing) columns: several distinct labels; labels and nulls."""
    conflict = F.array_compact(F.array(*[F.when(F.col(f"__lo_{a}") < F.col(f"__hi_{a}"), F.lit(a)) for a in columns]))
    mixed = F.array_compact(F.array(*[F.when((F.col(f"__n_{a}") > 0) & (F.col(f"__n_{a}") < n), F.lit(a)) for a in columns]))
    return conflict, mixed


def raw_summary(df: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    """unique_texts, duplicate_groups, members and redundant rows per split, by the text as it is."""
    groups = df.groupBy(F.col(spec.split).alias("split"), F.sha2(F.col(spec.text), 256).alias("__k")).agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    return groups.groupBy("split").agg(F.count("*").alias("unique_texts"), F.count_if(many).alias("duplicate_groups"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("members"), F.coalesce(F.sum(F.when(many, F.col("n") - 1)), F.lit(0)).alias("redundant"))


def keyed(df: DataFrame, spec: TableSpec) -> DataFrame:
    """df with group_id (hash of the normalised text) and raw_id; text crosses into Python once."""
    return df.withColumn("group_id", X.duplicate_key_digest_of(F.col(spec.text))).withColumn("raw_id", F.sha2(F.col(spec.text), 256))


def group_rows(df: DataFrame, spec: TableSpec) -> DataFrame:
    """One row per (split, group, raw text): counts, label spread, first row; a hot text is combined on the map side."""
    return keyed(df, spec).groupBy(F.col(spec.split).alias("split"), "group_id", "raw_id").agg(F.count("*").alias("n"), F.min(spec.row).alias("first_row"), *spread(spec.labels.columns))


def groups(df: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    """Groups of at least two rows: member_count, redundant, raw_variants, conflicting and mixed_missing columns, first_row."""
    cols = spec.labels.columns
    out = group_rows(df, spec).groupBy("split", "group_id").agg(
        F.sum("n").alias("member_count"), F.count("*").alias("raw_variants"), F.min("first_row").alias("first_row"),
        *[x for a in cols for x in (F.min(f"__lo_{a}").alias(f"__lo_{a}"), F.max(f"__hi_{a}").alias(f"__hi_{a}"), F.sum(f"__n_{a}").alias(f"__n_{a}"))],
    )
    conflict, mixed = from_spread(cols, F.col("member_count"))
    return out.where("member_count > 1").select("split", "group_id", "member_count", (F.col("member_count") - 1).alias("redundant"), "raw_variants", conflict.alias("conflicting"), mixed.alias("mixed_missing"), "first_row")


def members(df: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    """(split, group_id, row, id) of the members of groups, one row each: no list of members is ever gathered."""
    every = cut(keyed(df, spec).select(F.col(spec.split).alias("split"), "group_id", F.col(spec.row).alias("row"), F.col(spec.id).alias("id")))
    many = every.groupBy("split", "group_id").count().where("count > 1").drop("count")
    return every.join(many, ["split", "group_id"], "left_semi")


def normalized_summary(df: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    """Per split: unique texts, groups, members, redundant, and groups merged by normalisation, in conflict, mixed-missing, consistent."""
    cols = spec.labels.columns
    rows = group_rows(df, spec).groupBy("split", "group_id").agg(
        F.sum("n").alias("n"), F.count("*").alias("variants"),
        *[x for a in cols for x in (F.min(f"__lo_{a}").alias(f"__lo_{a}"), F.max(f"__hi_{a}").alias(f"__hi_{a}"), F.sum(f"__n_{a}").alias(f"__n_{a}"))],
    )
    conflict, mixed = from_spread(cols, F.col("n"))
    rows = rows.select("split", "n", "variants", (F.size(conflict) > 0).alias("c"), (F.size(mixed) > 0).alias("m"))
    many = F.col("n") > 1
    return rows.groupBy("split").agg(
        F.count("*").alias("unique_texts"), F.count_if(many).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("members"), F.coalesce(F.sum(F.when(many, F.col("n") - 1)), F.lit(0)).alias("redundant"),
        F.count_if(many & (F.col("variants") > 1)).alias("merged_groups"), F.count_if(many & F.col("c")).alias("conflict_groups"),
        F.count_if(many & F.col("m")).alias("mixed_missing_groups"), F.count_if(many & ~F.col("c") & ~F.col("m")).alias("consistent_groups"),
    )


def ordered(found: DataFrame) -> DataFrame:
    """Conflicts first, then mixed-missing, then size; ties by group."""
    return found.orderBy((F.size("conflicting") > 0).desc(), (F.size("mixed_missing") > 0).desc(), F.desc("member_count"), "group_id")
