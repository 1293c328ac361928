"""Duplicate groups over the whole table: components of exact and near evidence, ids and conflict policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.identity import group_id, group_ids, require_unique
from tallyloom.operators.exact import from_spread, spread
from tallyloom.operators.graph import connected_components, cut
from tallyloom.operators.validate import non_integer, out_of_range, require
from tallyloom.functions.text import WS, is_blank
from tallyloom.spec import LabelSpec

POLICIES = ("retain", "exclude", "manual_review")


def star_edges(members: DataFrame, group: list[str], member: str = "review_id") -> DataFrame:
    """Edges from each group's least member to its others: as many as members, whatever the group size."""
    first = members.groupBy(*group).agg(F.min(member).alias("src"))
    return members.join(first, group).where(F.col(member) != F.col("src")).select("src", F.col(member).alias("dst"))


def check_evidence(df: DataFrame, members: DataFrame, group: list[str], review_id: str = "review_id") -> None:
    """Evidence groups need known ids, without nulls, and at least two distinct ones each."""
    require(members, {"null member": F.col(review_id).isNull()})
    lone = members.groupBy(*group).agg(F.count_distinct(review_id).alias("n")).where("n < 2")
    if not lone.isEmpty():
        raise ValueError("an evidence group has fewer than two members")
    unknown = members.join(df.select(review_id), review_id, "left_anti")
    if not unknown.isEmpty():
        raise ValueError(f"unknown member {unknown.first()[review_id]}")


def check_rows(df: DataFrame, labels: LabelSpec, review_id: str = "review_id") -> None:
    edge = F.col(review_id).rlike(f"^{WS}|{WS}$")
    tests: dict[str, Column] = {"null id": F.col(review_id).isNull(), "blank id": is_blank(F.col(review_id)), "id with outer white space": edge}
    for a in labels.columns:
        tests[f"bad {a}"] = non_integer(F.col(a)) | out_of_range(F.col(a), labels.valid)
    require(df, tests)
    require_unique(df, review_id, [review_id])


def components(df: DataFrame, evidence: dict[str, DataFrame], review_id: str = "review_id") -> DataFrame:
    """(review_id, root): rows without evidence are their own root. evidence: type -> edges (src, dst)."""
    edges = None
    for e in evidence.values():
        e = e.select("src", "dst")
        edges = e if edges is None else edges.union(e)
    own = df.select(review_id)
    if edges is None:
        return own.withColumn("root", F.col(review_id))
    parts = connected_components(edges).select(F.col("node").alias(review_id), F.col("component").alias("root"))
    return own.join(parts, review_id, "left").withColumn("root", F.coalesce("root", review_id))


def evidence_types(roots: DataFrame, evidence: dict[str, DataFrame], review_id: str = "review_id") -> DataFrame:
    """(root, evidence): the kinds of edges in each component, sorted."""
    tagged = None
    for name, e in evidence.items():
        e = e.select(F.col("src").alias(review_id)).distinct().withColumn("kind", F.lit(name))
        tagged = e if tagged is None else tagged.union(e)
    if tagged is None:
        return roots.select("root").where("false").withColumn("evidence", F.array().cast("array<string>"))
    return tagged.join(roots, review_id).groupBy("root").agg(F.array_sort(F.collect_set("kind")).alias("evidence"))


def policy_flags(conflict: Column, policy: str) -> tuple[Column, Column]:
    """(retain_for_processing, requires_manual_review)"""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    return (~conflict if policy != "retain" else F.lit(True)), (conflict if policy == "manual_review" else F.lit(False))


def assign_groups(df: DataFrame, evidence: dict[str, DataFrame], policy: str = "retain", labels: LabelSpec = LabelSpec(), review_id: str = "review_id", checked: bool = False) -> DataFrame:
    """df with group_id, group_size, evidence, conflict columns and flags, and the policy's verdict.

    evidence: edges (src, dst) of review ids by type, as star_edges() makes them. Every row gets a
    group; group ids depend on the members alone, not on input order. Members are
    streamed through the hash in order; singletons skip that step.
    """
    cols = labels.columns
    slim = cut(df.select(review_id, *cols))  # read by every step; the rest of df, texts included, only once, by the last one
    evidence = {k: cut(e.select("src", "dst")) for k, e in evidence.items()}
    if not checked:
        check_rows(slim, labels, review_id)
    roots = cut(components(slim, evidence, review_id))
    rows = df.join(roots, review_id)
    facts = slim.join(roots, review_id).groupBy("root").agg(F.count("*").alias("group_size"), *spread(cols))
    conflict, mixed = from_spread(cols, F.col("group_size"))
    facts = facts.select("root", "group_size", conflict.alias("group_conflicting_label_columns"), mixed.alias("group_mixed_missing_label_columns"))
    many = facts.where("group_size > 1").select("root")
    ids = group_ids(roots.join(many, "root", "left_semi"), "root", review_id)
    out = rows.join(facts, "root").join(ids, "root", "left").join(evidence_types(roots, evidence, review_id), "root", "left")
    out = out.withColumn("group_id", F.coalesce("group_id", group_id(F.array(F.col(review_id))))).withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    has = F.size("group_conflicting_label_columns") > 0
    keep, manual = policy_flags(has, policy)
    return out.withColumns({
        "group_has_label_conflict": has, "group_has_mixed_missing_labels": F.size("group_mixed_missing_label_columns") > 0,
        "group_conflict_policy": F.lit(policy), "retain_for_processing": keep, "requires_manual_review": manual,
    }).drop("root")


def summary(assigned: DataFrame) -> DataFrame:
    """rows, groups, multi-member, conflict and mixed groups, excluded and held rows."""
    g = assigned.groupBy("group_id").agg(F.count("*").alias("n"), F.first("group_has_label_conflict").alias("c"), F.first("group_has_mixed_missing_labels").alias("m"), F.count_if(~F.col("retain_for_processing") & ~F.col("requires_manual_review")).alias("x"), F.count_if(F.col("requires_manual_review")).alias("h"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("multi_member_groups"), F.count_if("c").alias("conflict_groups"), F.count_if("m").alias("mixed_missing_groups"), F.coalesce(F.sum("x"), F.lit(0)).alias("excluded_rows"), F.coalesce(F.sum("h"), F.lit(0)).alias("manual_review_rows"))
