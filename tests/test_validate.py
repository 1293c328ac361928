import pytest
from pyspark.sql import functions as F

from tallyloom.operators import validate as V
from tallyloom.spec import ASPECTS, TableSpec

SCHEMA = "source_id long, row_index long, source_split string, text string, " + ", ".join(f"{a} double" for a in ASPECTS)


Z = (0.0,) * 4


def raw(spark, rows):
    return spark.createDataFrame([(i, n, "train", t, *labels) for n, (i, t, *labels) in enumerate(rows)], SCHEMA)


def found(df, spec=TableSpec()):
    return {(r.code, r.column): (r.severity, r["count"], r.sample_rows) for r in V.validate_raw(df, spec).collect()}


def test_sound_table_has_no_issues(spark):
    df = raw(spark, [(1, "ok", 0.0, 1.0, 2.0, 3.0, 0.0), (2, "so-so", 1.0, 1.0, 1.0, 1.0, 1.0)])
    assert found(df) == {}
    assert V.status(V.validate_raw(df)).first().valid


def test_broken_table(spark):
    df = raw(spark, [(1, "good", 4.0, *Z), (2, " \t ", 1.5, *Z), (3, None, None, float("nan"), 0.0, 0.0, 0.0)]).drop("service").withColumn("more", F.lit(1))
    got = found(df)
    assert got["missing_required_columns", "service"][0] == "error"
    assert got["unexpected_columns", "more"][0] == "warning"
    assert got["empty_review", "text"][1:] == (1, [1])
    assert got["null_review", "text"][1:] == (1, [2])
    assert got["non_integer_label", "material"][1:] == (1, [1])
    assert got["label_out_of_range", "material"][1:] == (2, [0, 1])  # a fraction is out of range too
    assert got["null_label", "material"][1] == got["null_label", "design"][1] == 1
    assert not V.status(V.validate_raw(df)).first().valid
    roll = V.label_rollup(V.validate_raw(df)).first()
    assert (roll.null_labels, roll.invalid_labels) == (2, 3)


def test_repeated_rows_are_warnings(spark):
    row = (1, "same", 0.0, *Z)
    df = raw(spark, [row, (2, "other", 0.0, *Z), row])
    got = found(df)
    assert got["duplicate_rows", None][:2] == ("warning", 2)
    assert got["duplicate_review_text", "text"][:2] == ("warning", 2)
    assert V.status(V.validate_raw(df)).first().valid


def test_no_rows_and_empty_split(spark):
    df = raw(spark, [(1, "x", 0.0, *Z)])
    assert ("no_splits", None) in found(df.limit(0))
    got = V.validate_raw(df, expected_splits=["train", "test"]).collect()
    assert [(r.code, r.split) for r in got] == [("empty_split", "test")]


def test_samples_stop_at_ten(spark):
    df = raw(spark, [(i, None, 0.0, *Z) for i in range(15)])
    assert found(df)["null_review", "text"][1:] == (15, list(range(10)))


def processed(spark, rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "row_index long, review_id string, group_id string, text string, " + ", ".join(f"{a} double" for a in ASPECTS) + ", split string")


def test_processed_contract(spark):
    spec = TableSpec(id="review_id", split="split")
    good = [("r1", "g1", "a", 0.0, 1.0, 2.0, 3.0, 0.0, "train"), ("r2", "g2", "b", 0.0, 1.0, 2.0, 3.0, 0.0, "validation"), ("r3", "g3", "c", 0.0, 1.0, 2.0, 3.0, 0.0, "test")]
    assert V.validate_processed(processed(spark, good), spec).count() == 0
    good[1] = ("r2", "g2", "b", None, 1.0, 2.0, 3.0, 0.0, "validation")
    one = V.validate_processed(processed(spark, good), spec).collect()
    assert [(r.code, r.severity, r.sample_rows) for r in one] == [("missing_label", "warning", [1])]
    bad = [("r1", " ", "a", 4.0, 1.5, 2.0, 3.0, 0.0, "train"), ("r1", "g2", "", 0.0, 1.0, 2.0, 3.0, 0.0, "dev")]
    got = V.validate_processed(processed(spark, bad).drop("service"), spec).orderBy("no").collect()
    assert [r.code for r in got] == "missing_required_columns empty_group_id empty_text invalid_split label_out_of_range non_integer_label duplicate_review_id".split()
    assert not any(r.code == "label_out_of_range" and r.column == "design" for r in got)  # a fraction is not out of range here
    assert [r.code for r in V.validate_processed(processed(spark, good).limit(0), spec).collect()] == ["empty_dataset"]


def test_require_interim(spark):
    spec = TableSpec(id="review_id", split="split")
    df = processed(spark, [("r1", "g1", "a", 0.0, 1.0, 2.0, 3.0, 0.0, "train")])
    V.require_interim(df, spec, "group_id")
    for broken in (df.drop("text"), df.limit(0), df.union(df), df.withColumn("text", F.lit(" ")), df.withColumn("size", F.lit(9.0))):
        with pytest.raises(ValueError):
            V.require_interim(broken, spec, "group_id")
