"""Command line: each command reads Parquet, writes result tables and a JSON report, and prints a summary.

Exit status 0: done (and valid); 1: `validate` found errors; 2: the command failed, or `check-splits` found
leakage or drift, whose report is written first.
"""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import eda, exact, near, profile, report, split, validate
from tallyloom.operators.graph import cut
from tallyloom.plans.preprocess import exact_evidence, interim_rows, listed_evidence, member_evidence, preprocess
from tallyloom.sources import io
from tallyloom.spec import ASPECTS, SEED, LabelSpec, TableSpec

log = logging.getLogger("tallyloom")
REPORT_ROWS = 1000  # of a table in a JSON report; the tables themselves are whole


def configure_logging(level: int = logging.INFO) -> logging.Logger:
    """One handler on the library's logger, however often this is called."""
    if not log.handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
        log.propagate = False
    log.setLevel(level)
    return log


def rows(df: DataFrame) -> list[dict]:
    """The first rows by all columns."""
    return [r.asDict(recursive=True) for r in df.orderBy(*[c for c, t in df.dtypes if not t.startswith("map")]).limit(REPORT_ROWS).collect()]


def source_of(df: DataFrame, spec: TableSpec) -> dict:
    """Which rows a report speaks of: their splits, number and digest."""
    own = sorted((str(r["split"]), r["rows"], r["digest"]) for r in io.metadata(df, spec.split, "", "").collect())  # a row per split
    return {"split": "|".join(s for s, _, _ in own), "rows": sum(n for _, n, _ in own), "digest": "|".join(d for _, _, d in own)}


def spec_of(a: argparse.Namespace) -> TableSpec:
    return TableSpec(id=a.id, text=a.text, split=a.split, row=a.row, labels=LabelSpec(columns=tuple(a.labels)))


def deliver(a: argparse.Namespace, tables: dict[str, DataFrame], report: dict | None = None) -> dict:
    """Write every table and one report with the small ones, of each of which it also gives the number of rows, as it shows no more than REPORT_ROWS."""
    out = Path(a.output)
    io.guard([out / f"{a.command}.json", *(out / t for t in tables)], a.force)
    for name, df in tables.items():
        io.write_table(df, str(out / name), a.force)
    spark = SparkSession.getActiveSession()
    small = {n: spark.read.parquet(str(out / n)) for n in tables if n in SMALL}
    value = {"command": a.command, "input": a.input, **(report or {}), "rows": {n: df.count() for n, df in small.items()}, "tables": {n: rows(df) for n, df in small.items()}}
    io.write_json(out / f"{a.command}.json", value)
    log.info("%s: %s", a.command, ", ".join(tables))
    return value


SMALL = {"issues", "labels", "label_summary", "mentions", "percentiles", "statistics", "thresholds", "patterns", "longest", "raw_summary", "normalized_summary", "summary", "audit", "split_summary", "split_labels", "drift", "balance", "median_samples", "mixed_samples", "product_codes", "metadata", "duplicate_chart"}


def run_validate(a, df, spec):
    issues = cut(validate.validate_raw(df, spec))
    state = validate.status(issues).first().asDict()
    deliver(a, {"issues": issues}, state | {"source": source_of(df, spec)})
    return 0 if state["valid"] else 1


def run_profile_labels(a, df, spec):
    profile.require_labels(df, spec)
    deliver(a, {"labels": profile.label_distribution(df, spec), "label_summary": profile.label_summary(df, spec), "mentions": profile.mentioned_aspects(df, spec)}, {"source": source_of(df, spec)})


def run_profile_text(a, df, spec):
    sizes = cut(profile.lengths(df, spec))
    deliver(a, {"percentiles": profile.length_percentiles(sizes), "statistics": profile.length_statistics(sizes), "thresholds": profile.threshold_counts(sizes), "patterns": profile.pattern_signals(df, spec), "longest": profile.longest(df, spec)}, {"source": source_of(df, spec)})


def run_duplicates(a, df, spec):
    exact.require_text(df, spec)
    deliver(a, {"raw_summary": exact.raw_summary(df, spec), "normalized_summary": exact.normalized_summary(df, spec), "groups": exact.ordered(exact.groups(df, spec)), "members": exact.members(df, spec).orderBy("split", "group_id", "row")}, {"source": source_of(df, spec)})


def run_near_duplicates(a, df, spec):
    exact.require_text(df, spec)
    source = source_of(df, spec)
    if a.sample:
        df = profile.even_sample(df, a.sample, spec.row)
    got = near.analyze(df, spec)
    tables = {"pairs": near.ordered_pairs(got["pairs"]), "members": got["members"].orderBy("split", "root", "row"), "clusters": near.ordered_clusters(got["clusters"]), "summary": got["summary"]}
    tables["duplicate_chart"] = eda.duplicate_chart(exact.normalized_summary(df, spec), got["summary"])
    deliver(a, tables, {"source": source, "sample": a.sample})


def run_eda(a, df, spec):
    tables = {"balance": eda.class_balance(df, spec), "label_chart": eda.label_chart(df, spec), "histogram": eda.length_histogram(df, spec), "median_samples": eda.median_samples(df, spec), "mixed_samples": eda.mixed_samples(df, spec), "product_codes": eda.product_code_samples(df, spec)}
    report = deliver(a, tables, {"source": source_of(df, spec)})
    io.write_atomic(Path(a.output) / "eda.md", eda.markdown("Summary", report["tables"]).encode())


def run_report(a, df, spec):
    """Input: a folder in which the other commands have written their reports, each in a folder of its own or all in one."""
    found = {p: next((f for f in (Path(a.input) / f"{p}.json", Path(a.input) / p / f"{p}.json") if f.exists()), None) for p in report.PARTS}
    value = report.summarize({p: io.read_json(f) for p, f in found.items() if f})
    out = Path(a.output)
    io.guard([out / "summary.json", out / "report.md"], a.force)
    io.write_json(out / "summary.json", value)
    io.write_atomic(out / "report.md", report.document(value).encode())


def run_preprocess(a, df, spec):
    evidence = None
    if a.near or a.groups:
        ids = interim_rows(df, a.dataset, a.revision, spec)
        evidence = {"exact": exact_evidence(df, ids, spec)}
        if a.near:
            got = near.analyze(df, spec)
            evidence["high_confidence_near"] = member_evidence(got["members"], got["prepared"], ids)
        if a.groups:
            evidence["listed"] = listed_evidence(io.read_groups(df.sparkSession, a.groups), ids)
    interim, audit = preprocess(df, a.dataset, a.revision, evidence, a.policy, spec)
    deliver(a, {"interim": interim, "audit": audit})


def run_split(a, df, spec):
    interim_spec = TableSpec(id="review_id", labels=spec.labels)
    validate.require_interim(df, interim_spec, "group_id")
    member = cut(split.assign_splits(df, spec.labels, a.seed))
    merged = cut(split.joined(df, member))
    deliver(a, {"membership": member.orderBy("review_id"), "split_summary": split.split_summary(merged), "split_labels": split.split_labels(merged)}, {"seed": a.seed})


def run_check_splits(a, df, spec):
    member = df.sparkSession.read.parquet(a.membership)
    issues = cut(split.check(df, member, spec.labels, a.tolerance))
    deliver(a, {"issues": issues}, {"valid": issues.isEmpty(), "tolerance": a.tolerance})
    return 0 if issues.isEmpty() else 2


def run_pin(a, df, spec):
    io.guard([Path(a.output)], a.force)
    io.write_metadata(df, spec.split, a.dataset, a.revision, a.input, a.output)


COMMANDS = {"validate": run_validate, "profile-labels": run_profile_labels, "profile-text": run_profile_text, "duplicates": run_duplicates, "near-duplicates": run_near_duplicates, "eda": run_eda, "preprocess": run_preprocess, "split": run_split, "check-splits": run_check_splits, "pin": run_pin, "report": run_report}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyloom", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--input", required=True, help="Parquet table, CSV file (.csv), or a metadata file made by `pin` (.json); for `report` a folder of reports")
    p.add_argument("--output", required=True)
    p.add_argument("--force", action="store_true", help="overwrite outputs")
    for name, value in (("id", "source_id"), ("text", "text"), ("split", "source_split"), ("row", "row_index"), ("dataset", "dataset"), ("revision", "r1"), ("policy", "retain")):
        p.add_argument(f"--{name}", default=value)
    p.add_argument("--labels", nargs="*", default=list(ASPECTS))
    p.add_argument("--sample", type=int)
    p.add_argument("--near", action="store_true", help="preprocess: use near duplicates as evidence too")
    p.add_argument("--groups", help="preprocess: a CSV of groups (split, |-joined member_ids) as further evidence")
    p.add_argument("--no-verify", action="store_true", help="open a pinned table without checking that it is still the same")
    p.add_argument("--schema", help="of a CSV file, as DDL; by default ids and rows are long, labels double, the rest text")
    p.add_argument("--membership", help="check-splits: the membership table")
    p.add_argument("--tolerance", type=float, default=split.TOLERANCE)
    p.add_argument("--seed", type=int, default=SEED)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    configure_logging()
    spark = SparkSession.builder.appName("tallyloom").getOrCreate()
    try:
        if a.command == "report":
            return run_report(a, None, None) or 0
        if a.input.endswith(".json"):
            df = io.open_pinned(spark, a.input, a.split, verify=not a.no_verify)
        elif a.input.endswith(".csv"):
            df = io.read_csv(spark, a.input, a.schema) if a.schema else io.read_labelled_csv(spark, a.input, [a.id, a.row], a.labels)
        else:
            df = io.read_table(spark, a.input)
        if a.command != "pin" and a.row not in df.columns and a.id in df.columns:
            df = df.withColumn(a.row, F.col(a.id).cast("long"))  # ids stand for the row order where there is none
        return COMMANDS[a.command](a, df, spec_of(a)) or 0
    except Exception as e:  # noqa: BLE001
        log.error("%s failed: %s", a.command, str(e).split("\n")[0])
        return 2


if __name__ == "__main__":
    sys.exit(main())
