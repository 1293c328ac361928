"""Table contracts as one fused aggregate per table: issues are rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.text import is_blank
from tallyloom.spec import SPLITS, TableSpec

INTEGERS, NUMBERS = ("tinyint", "smallint", "int", "bigint"), ("tinyint", "smallint", "int", "bigint", "float", "double")
SAMPLES = 10


def non_integer(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (c.cast("double") % 1 != 0)


def null_label(c: Column) -> Column:
    """NaN is how a float column says null."""
    return c.isNull() | F.isnan(c.cast("double"))


def out_of_range(c: Column, valid: tuple[int, ...]) -> Column:
    return ~null_label(c) & ~c.cast("double").isin([float(v) for v in valid])


def counted(df: DataFrame, tests: list[tuple[str, str, str | None, Column]], spec: TableSpec, samples: bool) -> DataFrame:
    """(split, no, code, severity, column, count) of the tests that hit, from one pass; then the first rows of each hit."""
    names = [f"__t{i}" for i in range(len(tests))]
    split = F.col(spec.split) if spec.split in df.columns else F.lit(None).cast("string")
    flagged = df.withColumn("__split", split).withColumns({n: F.coalesce(t[3], F.lit(False)) for n, t in zip(names, tests)})
    hits = flagged.groupBy("__split").agg(*[F.count_if(F.col(n)).alias(n) for n in names])
    long = hits.select("__split", F.inline(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(t[0]).alias("code"), F.lit(t[1]).alias("severity"), F.lit(t[2]).cast("string").alias("column"), F.col(n).alias("count")) for i, (n, t) in enumerate(zip(names, tests))])))
    long = long.where("count > 0").withColumnRenamed("__split", "split")
    if not samples or spec.row not in df.columns:
        return long.withColumn("sample_rows", F.lit(None).cast("array<long>"))
    hit_rows = flagged.select("__split", F.col(spec.row).alias("__row"), F.explode(F.array_compact(F.array(*[F.when(F.col(n), F.lit(i)) for i, n in enumerate(names)]))).alias("__no"))
    first = hit_rows.withColumn("__rn", F.row_number().over(W.partitionBy("__split", "__no").orderBy("__row"))).where(F.col("__rn") <= SAMPLES)
    first = first.groupBy("__split", "__no").agg(F.array_sort(F.collect_list("__row")).alias("sample_rows"))
    return long.join(first, long["split"].eqNullSafe(first["__split"]) & (long["no"] == first["__no"]), "left").drop("__split", "__no")


def issue(found: DataFrame, no: int, code: str, severity: str, column: str | None, split: Column | None = None, count: Column | None = None) -> DataFrame:
    """found's rows as issues of one code."""
    text = F.lit(None).cast("string")
    return found.select((text if split is None else split).alias("split"), F.lit(no).alias("no"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(column).cast("string").alias("column"), (F.lit(0).cast("long") if count is None else count).alias("count"), F.lit(None).cast("array<long>").alias("sample_rows"))


def if_empty(df: DataFrame) -> DataFrame:
    """One row if df has none."""
    return df.limit(1).agg(F.count("*").alias("n")).where("n = 0")


def duplicate_rows(df: DataFrame, columns: list[str], by: list[str] = []) -> DataFrame:
    """Rows that occur more than once (all members count): count per `by`; nulls equal nulls."""
    groups = df.groupBy(*by, *[c for c in columns if c not in by]).agg(F.count("*").alias("__n")).where("__n > 1")
    return groups.groupBy(*by).agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("count"))


def raw_tests(df: DataFrame, spec: TableSpec) -> list[tuple[str, str, str | None, Column]]:
    kinds, tests = dict(df.dtypes), []
    everywhere = F.lit(True)
    for c in (spec.id, spec.text, *spec.labels.columns):
        if c not in kinds:
            tests.append(("missing_required_columns", "error", c, everywhere))
    known = {spec.id, spec.text, spec.split, spec.row, *spec.labels.columns}
    tests += [("unexpected_columns", "warning", c, everywhere) for c in kinds if c not in known]
    if spec.id in kinds:
        tests.append(("null_identifier", "error", spec.id, F.col(spec.id).isNull()))
        if kinds[spec.id] not in INTEGERS:
            tests.append(("invalid_identifier_type", "error", spec.id, everywhere))
    if spec.text in kinds:
        tests.append(("null_review", "error", spec.text, F.col(spec.text).isNull()))
        if kinds[spec.text] != "string":
            tests.append(("invalid_review_type", "error", spec.text, everywhere))
        else:
            tests.append(("empty_review", "error", spec.text, is_blank(F.col(spec.text))))
    for c in spec.labels.columns:
        if c in kinds:
            tests.append(("null_label", "error", c, null_label(F.col(c)) if kinds[c] in NUMBERS else F.col(c).isNull()))
            if kinds[c] not in NUMBERS:
                tests.append(("invalid_label_type", "error", c, everywhere))
                continue
            tests.append(("non_integer_label", "error", c, non_integer(F.col(c))))
            tests.append(("label_out_of_range", "error", c, out_of_range(F.col(c), spec.labels.valid)))
    return tests


def validate_raw(df: DataFrame, spec: TableSpec = TableSpec(), samples: bool = True, expected_splits: list[str] | None = None) -> DataFrame:
    """Issues (split, no, code, severity, column, count, sample_rows) of the raw contract, in contract order by `no`.

    Missing labels are errors here. A fraction is both non-integer and out of range. An expected
    split without rows is an `empty_split`; a table without rows and expectations is `no_splits`.
    """
    tests = raw_tests(df, spec)
    out = counted(df, tests, spec, samples)
    by = [spec.split] if spec.split in df.columns else []
    body = [c for c in (spec.id, spec.text, *spec.labels.columns) if c in df.columns]
    extra = [(900, "duplicate_rows", None, duplicate_rows(df, body, by))]
    if spec.text in df.columns:
        extra.append((901, "duplicate_review_text", spec.text, duplicate_rows(df.where(F.col(spec.text).isNotNull()), [spec.text], by)))
    for no, code, column, found in extra:
        out = out.unionByName(issue(found.where("count > 0"), no, code, "warning", column, F.col(by[0]) if by else None, F.col("count")))
    if expected_splits is not None:
        want = df.sparkSession.createDataFrame([(s,) for s in expected_splits], "split string")
        gone = want.join(df.select(F.col(spec.split).alias("split")).distinct(), "split", "left_anti")
        return out.unionByName(issue(gone, -1, "empty_split", "error", None, F.col("split")))
    return out.unionByName(issue(if_empty(df), -1, "no_splits", "error", None))


def status(issues: DataFrame) -> DataFrame:
    """errors, warnings, valid of an issues table: failed if there is any error."""
    return issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn("valid", F.col("errors") == 0)


def validate_processed(df: DataFrame, spec: TableSpec = TableSpec(id="review_id", split="split"), group: str = "group_id", samples: bool = True) -> DataFrame:
    """Issues of the processed contract: missing labels are warnings, and only integral labels can be out of range."""
    kinds, tests = dict(df.dtypes), []
    required = [spec.id, group, spec.text, *spec.labels.columns, spec.split]
    tests += [("missing_required_columns", "error", c, F.lit(True)) for c in required if c not in kinds]
    for c in (spec.id, group, spec.text):
        if c in kinds:
            tests.append((f"null_{c}", "error", c, F.col(c).isNull()))
            tests.append((f"empty_{c}", "error", c, is_blank(F.col(c).cast("string"))))
    if spec.split in kinds:
        tests.append(("invalid_split", "error", spec.split, F.col(spec.split).isNull() | ~F.col(spec.split).isin(list(SPLITS))))
    for c in spec.labels.columns:
        if c not in kinds:
            continue
        tests.append(("missing_label", "warning", c, null_label(F.col(c)) if kinds[c] in NUMBERS else F.col(c).isNull()))
        if kinds[c] not in NUMBERS:
            tests.append(("invalid_label_type", "error", c, F.lit(True)))
            continue
        whole = ~non_integer(F.col(c))
        tests.append(("non_integer_label", "error", c, non_integer(F.col(c))))
        tests.append(("label_out_of_range", "error", c, whole & out_of_range(F.col(c), spec.labels.valid)))
    whole_table = TableSpec(id=spec.id, text=spec.text, split="\0", row=spec.row, labels=spec.labels)
    out = counted(df, tests, whole_table, samples)
    if spec.id in kinds:
        twice = duplicate_rows(df.where(F.col(spec.id).isNotNull()), [spec.id]).where("count > 0")
        out = out.unionByName(issue(twice, 900, "duplicate_review_id", "error", spec.id, None, F.col("count")))
    return out.unionByName(issue(if_empty(df), -1, "empty_dataset", "error", None))


def label_rollup(issues: DataFrame) -> DataFrame:
    """Null and invalid labels summed over issues; an issue without a count counts as 1."""
    bad = F.col("code").isin("non_integer_label", "label_out_of_range", "invalid_label_type")
    n = F.coalesce("count", F.lit(1))
    return issues.agg(F.coalesce(F.sum(F.when(F.col("code") == "null_label", n)), F.lit(0)).alias("null_labels"), F.coalesce(F.sum(F.when(bad, n)), F.lit(0)).alias("invalid_labels"))


def require(df: DataFrame, tests: dict[str, Column]) -> None:
    """Raise ValueError naming the tests that any row meets; one aggregate for all."""
    got = df.agg(F.count("*").alias("__n"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()]).first()
    found = [f"{n}: {got[n]} rows" for n in tests if got[n]]
    if found:
        raise ValueError("; ".join(found))


def require_interim(df: DataFrame, spec: TableSpec, group: str) -> None:
    """The fail-fast checks before a split: columns, rows, nulls, blanks, unique ids and labels."""
    missing = [c for c in (spec.id, group, spec.text, *spec.labels.columns) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    tests = {}
    for c in (spec.id, group, spec.text):
        tests[f"null {c}"] = F.col(c).isNull()
        tests[f"blank {c}"] = is_blank(F.col(c).cast("string"))
    for c in spec.labels.columns:
        tests[f"bad {c}"] = non_integer(F.col(c)) | out_of_range(F.col(c), spec.labels.valid)
    require(df, tests)
    if not df.groupBy(spec.id).count().where("count > 1").isEmpty():
        raise ValueError(f"{spec.id} is not unique")

