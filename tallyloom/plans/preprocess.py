"""From a raw table to the interim table: validation, normalisation, ids, grouping, conflict policy, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.identity import require_identity, require_unique, review_id
from tallyloom.functions.text import review_text_of
from tallyloom.operators import grouping
from tallyloom.operators.exact import members
from tallyloom.operators.validate import validate_raw
from tallyloom.spec import INTERIM, TableSpec

TOLERATED = {"null_label"}


def interim_rows(df: DataFrame, dataset: str, revision: str, spec: TableSpec = TableSpec()) -> DataFrame:
    """review_id, source_split, source_id, source_text, text (normalised, case kept) and integer labels."""
    require_identity(df, dataset, revision, spec.split, spec.id)
    labels = [F.when(~F.isnan(F.col(a).cast("double")), F.col(a)).cast("int").alias(a) for a in spec.labels.columns]
    return df.select(review_id(F.col(spec.split), F.col(spec.id), dataset, revision).alias("review_id"), F.col(spec.split).alias("source_split"), F.col(spec.id).alias("source_id"), F.col(spec.text).alias("source_text"), review_text_of(F.col(spec.text)).alias("text"), *labels)


def require_valid(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The raw issues; raises ValueError for any error but a missing label."""
    issues = validate_raw(df, spec, samples=False)
    fatal = issues.where((F.col("severity") == "error") & ~F.col("code").isin(list(TOLERATED))).select("code", "count").limit(20).collect()
    if fatal:
        raise ValueError(f"raw validation failed: {[tuple(r) for r in fatal]}")
    return issues


def exact_evidence(df: DataFrame, rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Edges between the review ids of exact duplicates, within source splits."""
    ids = rows.select(F.col("source_split").alias("split"), F.col("source_id").alias("id"), "review_id")
    return grouping.star_edges(members(df, spec).join(ids, ["split", "id"]), ["split", "group_id"])


def near_evidence(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges between the review ids of high-confidence pairs."""
    ids = rows.select(F.col("source_split").alias("split"), F.col("source_id").cast("string").alias("__id"), "review_id")
    high = pairs.where("confidence = 'high_confidence'").select("split", F.col("first_id").cast("string").alias("__id"), F.col("second_id").cast("string").alias("__id2"))
    one = high.join(ids, ["split", "__id"]).select("split", F.col("review_id").alias("src"), F.col("__id2").alias("__id"))
    return one.join(ids, ["split", "__id"]).select("src", F.col("review_id").alias("dst"))


def member_evidence(members: DataFrame, prep: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges between the review ids of a near cluster's members, as many as members: the same components as all its high-confidence pairs give."""
    ids = rows.select(F.col("source_split").alias("split"), F.col("source_id").alias("id"), "review_id")
    return grouping.star_edges(members.join(prep.select("split", "row", "id"), ["split", "row"]).join(ids, ["split", "id"]), ["split", "root"])


def listed_evidence(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges from a table of listed groups (group_no, split, member_id); ids unknown to the table raise ValueError."""
    ids = rows.select(F.col("source_split").alias("split"), F.col("source_id").cast("string").alias("member_id"), "review_id")
    unknown = groups.join(ids, ["split", "member_id"], "left_anti")
    if not unknown.isEmpty():
        raise ValueError(f"unknown member {unknown.first()['member_id']}")
    return grouping.star_edges(groups.join(ids, ["split", "member_id"]), ["group_no", "split"])


def preprocess(df: DataFrame, dataset: str, revision: str, evidence: dict[str, DataFrame] | None = None, policy: str = "retain", spec: TableSpec = TableSpec(), pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(interim table, audit row). Without given evidence, exact groups are found here; near pairs are added if given.

    Rows held for manual review stay in the table; excluded ones go.
    """
    require_valid(df, spec)
    rows = interim_rows(df, dataset, revision, spec)
    require_unique(rows, "review_id", ["source_split", "source_id"])
    if evidence is None:
        evidence = {"exact": exact_evidence(df, rows, spec)}
        if pairs is not None:
            evidence["high_confidence_near"] = near_evidence(pairs, rows)
    grouped = grouping.assign_groups(rows, evidence, policy, spec.labels, checked=True)
    out = grouped.where("retain_for_processing OR requires_manual_review") if policy == "exclude" else grouped
    return out.select(*[f.name for f in INTERIM.fields]), audit(grouped, spec)


def audit(grouped: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    """input, written, removed and held rows, missing cells, groups, noteworthy groups (conflict or mixed-missing)."""
    missing = sum((F.when(F.col(a).isNull(), 1).otherwise(0) for a in spec.labels.columns), F.lit(0))
    keep = F.col("retain_for_processing") | F.col("requires_manual_review")
    g = grouped.groupBy("group_id").agg(F.count("*").alias("n"), F.sum(missing).alias("missing"), F.count_if(keep).alias("written"), F.count_if("requires_manual_review").alias("held"), F.first(F.col("group_has_label_conflict") | F.col("group_has_mixed_missing_labels")).alias("note"))
    return g.agg(F.sum("n").alias("input_rows"), F.sum("written").alias("written_rows"), F.sum(F.col("n") - F.col("written")).alias("removed_rows"), F.sum("held").alias("held_rows"), F.sum("missing").alias("missing_label_cells"), F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("candidate_groups"), F.count_if("note").alias("noteworthy_groups"))
