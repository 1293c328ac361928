"""Group-aware train/validation/test split, its report, and the leakage and drift checks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.identity import order_key
from tallyloom.functions.text import review_text_of
from tallyloom.spec import MISSING, RATIOS, SEED, SPLITS, LabelSpec

DRIVER_GROUPS = 200_000
TOLERANCE = 0.05


def normalized_ratios(ratios: dict[str, float] | None = None) -> dict[str, float]:
    ratios = dict(RATIOS if ratios is None else ratios)
    if set(ratios) != set(SPLITS) or any(not ratios[s] > 0 for s in SPLITS):
        raise ValueError("every split needs a positive ratio")
    total = sum(ratios[s] for s in SPLITS)
    return {s: ratios[s] / total for s in SPLITS}


def cells(labels: LabelSpec) -> list[tuple[str, str]]:
    """Label counters in the order in which the score adds them: aspects, then labels ascending, missing last."""
    return [(a, x) for a in labels.columns for x in (*map(str, labels.valid), MISSING)]


def group_summaries(df: DataFrame, labels: LabelSpec = LabelSpec(), seed: int = SEED, group: str = "group_id") -> DataFrame:
    """group_id, row_count, one counter per label cell (k0, k1, ...), order_key."""
    count = lambda a, x: F.count_if(F.col(a).isNull()) if x == MISSING else F.count_if(F.col(a) == int(x))
    out = df.groupBy(F.col(group).alias("group_id")).agg(F.count("*").alias("row_count"), *[count(a, x).alias(f"k{i}") for i, (a, x) in enumerate(cells(labels))])
    return out.withColumn("order_key", order_key(F.col("group_id"), seed))


def greedy(rows: list[tuple[int, list[int]]], ratios: dict[str, float]) -> list[int]:
    """greedy_steps() over all groups."""
    width = len(rows[0][1]) if rows else 0
    return list(greedy_steps(rows, ratios, sum(r for r, _ in rows), [sum(c[k] for _, c in rows) for k in range(width)]))


def greedy_steps(rows: Iterable[tuple[int, list[int]]], ratios: dict[str, float], n: int, totals: list[int]) -> Iterator[int]:
    """The split of each group (row_count, counters), in the order given: the one with the least score, ties to the first.

    The score is four times the squared row deviation plus the mean relative deviation of the
    counters, whose totals over all groups are given with the number of rows. Terms are added one by
    one in a fixed order, so that ties fall the same way everywhere.
    """
    width = len(totals)
    share = [ratios[s] for s in SPLITS]
    have, counts = [0] * len(SPLITS), [[0] * len(SPLITS) for _ in range(width)]
    used = [k for k in range(width) if totals[k]]
    targets = [[totals[k] * share[s] for s in range(len(SPLITS))] for k in range(width)]
    row_targets = [n * x for x in share]
    scale, terms = max(n, 1), len(used) * len(SPLITS)
    for size, own in rows:
        best, chosen = None, 0
        for s in range(len(SPLITS)):
            row_score = 0.0
            for t in range(len(SPLITS)):
                row_score += ((have[t] + (size if t == s else 0) - row_targets[t]) / scale) ** 2
            label_score = 0.0
            for k in used:
                total, target, now = totals[k], targets[k], counts[k]
                for t in range(len(SPLITS)):
                    label_score += abs(now[t] + (own[k] if t == s else 0) - target[t]) / total
            if terms:
                label_score /= terms
            score = 4.0 * row_score + label_score
            if best is None or score < best:
                best, chosen = score, s
        yield chosen
        have[chosen] += size
        for k in used:
            counts[k][chosen] += own[k]


def assign_splits(df: DataFrame, labels: LabelSpec = LabelSpec(), seed: int = SEED, ratios: dict[str, float] | None = None, review_id: str = "review_id", group: str = "group_id", driver_groups: int = DRIVER_GROUPS) -> DataFrame:
    """(review_id, group_id, split), a group never being divided.

    Greedy assignment goes through the groups one after another, largest first, in one task at every
    size: the totals are summed before, and the sorted groups stream through it. `driver_groups` has no
    effect; it once set from how many groups on they were assigned in independent blocks.
    """
    share, width = normalized_ratios(ratios), len(cells(labels))
    counters = [f"k{i}" for i in range(width)]
    groups = group_summaries(df, labels, seed, group)
    n, *totals = (x or 0 for x in groups.agg(F.sum("row_count"), *[F.sum(k) for k in counters]).first())

    def run(it):
        held: list = []  # the group ids of the batch at hand

        def feed():
            for pdf in it:
                held.append(pdf["group_id"])
                yield from zip(pdf["row_count"].tolist(), pdf[counters].values.tolist())

        out: list[str] = []
        for s in greedy_steps(feed(), share, n, totals):
            out.append(SPLITS[s])
            while held and len(held[0]) == 0:
                held.pop(0)
            if len(out) == len(held[0]):
                yield pd.DataFrame({"group_id": held.pop(0), "split": out})
                out = []

    one = groups.repartition(1).sortWithinPartitions(F.desc("row_count"), F.asc_nulls_last("order_key"), F.asc_nulls_last("group_id"))
    chosen = one.mapInPandas(run, "group_id string, split string")
    return df.select(review_id, F.col(group).alias("group_id")).join(chosen, "group_id").select(review_id, "group_id", "split")


def hash_splits(df: DataFrame, seed: int = SEED, ratios: dict[str, float] | None = None, review_id: str = "review_id", group: str = "group_id") -> DataFrame:
    """A split by the order key alone: no state, one pass, ratios in expectation."""
    share = normalized_ratios(ratios)
    u = F.conv(F.substring(order_key(F.col(group), seed), 1, 13), 16, 10).cast("double") / float(1 << 52)
    split = F.when(u < share["train"], F.lit("train")).when(u < share["train"] + share["validation"], F.lit("validation")).otherwise(F.lit("test"))
    return df.select(review_id, F.col(group).alias("group_id"), split.alias("split"))


def joined(interim: DataFrame, membership: DataFrame, review_id: str = "review_id") -> DataFrame:
    """interim with split, one to one on (review_id, group_id); raises if keys repeat or rows are lost."""
    for name, t in (("interim", interim), ("membership", membership)):
        if not t.groupBy(review_id, "group_id").count().where("count > 1").isEmpty():
            raise ValueError(f"{name} keys repeat")
    out = interim.join(membership.select(review_id, "group_id", "split"), [review_id, "group_id"])
    if out.count() != interim.count():
        raise ValueError("the membership does not cover the interim table")
    return out


def split_summary(merged: DataFrame, labels: LabelSpec = LabelSpec()) -> DataFrame:
    """(split, rows, groups, ratio) with a row for every split, then one row per split and label cell in split_labels()."""
    base = merged.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    # groups are counted by their distinct pairs first, so that no split is gathered into one task
    groups = merged.groupBy("split", "group_id").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("rows"), F.count("*").alias("groups"))
    out = base.join(groups, "split", "left").na.fill(0)
    total = F.sum("rows").over(W.partitionBy(F.lit(1)))
    return out.withColumn("ratio", F.when(total > 0, F.col("rows") / F.when(total > 0, total)).otherwise(F.lit(0.0)))


def split_labels(merged: DataFrame, labels: LabelSpec = LabelSpec()) -> DataFrame:
    """(split, aspect, label, count), zero counts included for splits that have rows."""
    count = lambda a, x: F.count_if(F.col(a).isNull()) if x == MISSING else F.count_if(F.col(a) == int(x))
    wide = merged.groupBy("split").agg(F.count("*").alias("split_rows"), *[count(a, x).alias(f"k{i}") for i, (a, x) in enumerate(cells(labels))])
    return wide.select("split", "split_rows", F.inline(F.array(*[F.struct(F.lit(a).alias("aspect"), F.lit(x).alias("label"), F.col(f"k{i}").alias("count")) for i, (a, x) in enumerate(cells(labels))])))


def drift(merged: DataFrame, labels: LabelSpec = LabelSpec(), tolerance: float = TOLERANCE) -> DataFrame:
    """(split, aspect, label, count, proportion, overall_proportion, drift, violation) for every split and label cell; an empty split has proportion 0; a violation is strictly above the tolerance."""
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    own = split_labels(merged, labels)
    every = own.groupBy("aspect", "label").agg(F.sum("count").alias("__all"))
    rows = own.select("split", "split_rows").distinct().agg(F.sum("split_rows").alias("__rows"))
    grid = merged.sparkSession.createDataFrame([(s, a, x) for s in SPLITS for a, x in cells(labels)], "split string, aspect string, label string")
    out = grid.join(own, ["split", "aspect", "label"], "left").join(every, ["aspect", "label"]).join(F.broadcast(rows))  # one row
    p = F.when(F.col("split_rows") > 0, F.col("count") / F.col("split_rows")).otherwise(F.lit(0.0))
    out = out.withColumn("proportion", p).withColumn("overall_proportion", F.col("__all") / F.col("__rows"))
    out = out.withColumn("drift", F.abs(F.col("proportion") - F.col("overall_proportion")))
    return out.select("split", "aspect", "label", F.coalesce("count", F.lit(0)).alias("count"), "proportion", "overall_proportion", "drift", (F.col("drift") > tolerance).alias("violation"))


def group_leakage(merged: DataFrame) -> DataFrame:
    """(group_id, splits, rows) of groups that lie in several splits."""
    pairs = merged.groupBy("group_id", "split").agg(F.count("*").alias("n"))
    return pairs.groupBy("group_id").agg(F.count("*").alias("splits"), F.sum("n").alias("rows"), F.array_join(F.array_sort(F.collect_set("split")), "|").alias("split_names")).where("splits > 1")


def text_leakage(merged: DataFrame, text: str = "text") -> DataFrame:
    """(text_sha256, splits, rows) of normalised texts in several splits; the text itself is not shown. Case counts here."""
    keyed = merged.select(F.sha2(review_text_of(F.col(text)), 256).alias("text_sha256"), "split")
    pairs = keyed.groupBy("text_sha256", "split").agg(F.count("*").alias("n"))
    return pairs.groupBy("text_sha256").agg(F.count("*").alias("splits"), F.sum("n").alias("rows")).where("splits > 1 AND rows > 1")


def contract_issues(interim: DataFrame, membership: DataFrame, review_id: str = "review_id") -> DataFrame:
    """(code, count) of what is wrong between the two tables: empty tables, repeated ids, unknown splits, ids missing on either side, differing groups, empty splits."""
    one = lambda df, code, c=F.count("*"): df.agg(c.alias("count")).withColumn("code", F.lit(code))
    ids, known = membership.select(review_id), interim.select(review_id)
    twice = membership.groupBy(review_id).agg(F.count("*").alias("n")).where("n > 1")
    both = interim.alias("i").join(membership.alias("m"), review_id).where("NOT (i.group_id <=> m.group_id)")
    have = membership.where(F.col("split").isin(list(SPLITS))).select("split").distinct()
    none = membership.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string").join(have, "split", "left_anti")
    parts = [
        one(interim.limit(1), "empty_interim_dataset", (F.count("*") == 0).cast("long")), one(membership.limit(1), "empty_split_ids", (F.count("*") == 0).cast("long")),
        one(twice, "duplicate_split_review_id", F.coalesce(F.sum("n"), F.lit(0))), one(membership.where(F.col("split").isNull() | ~F.col("split").isin(list(SPLITS))), "invalid_split_name"),
        one(known.join(ids, review_id, "left_anti"), "missing_split_review_id"), one(ids.join(known, review_id, "left_anti"), "unknown_split_review_id"),
        one(both, "split_group_id_mismatch"), one(none, "empty_split"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("code", F.col("count").cast("long").alias("count")).where("count > 0")


def check(interim: DataFrame, membership: DataFrame, labels: LabelSpec = LabelSpec(), tolerance: float = TOLERANCE, review_id: str = "review_id") -> DataFrame:
    """All issues (code, count) of a split: contract, group leakage, text leakage, drift."""
    merged = interim.drop("split", "group_id").join(membership.select(review_id, "group_id", "split"), review_id)
    one = lambda df, code: df.agg(F.count("*").alias("count")).select(F.lit(code).alias("code"), "count").where("count > 0")
    return (
        contract_issues(interim, membership, review_id)
        .unionByName(one(group_leakage(merged), "group_id_crosses_splits"))
        .unionByName(one(text_leakage(merged), "normalized_exact_duplicate_crosses_splits"))
        .unionByName(one(drift(merged, labels, tolerance).where("violation"), "label_distribution_drift_exceeds_tolerance"))
    )
