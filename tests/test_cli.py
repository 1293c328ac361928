import json

import pytest

from tallyloom import cli
from tallyloom.spec import ASPECTS

SCHEMA = "source_id long, source_split string, text string, " + ", ".join(f"{a} double" for a in ASPECTS)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in") / "t")
    words = "mềm ấm bền rộng chật đẹp xấu dày mỏng nhẹ".split()
    rows = [(i, "train", "twice the same text" if i in (3, 7) else " ".join(words[(i * k) % 10] for k in range(1, 9)) + f" {i}", *[float((i + k) % 4) for k in range(5)]) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return path


def run(command, table, out, *more):
    return cli.main([command, "--input", table, "--output", str(out), *more])


@pytest.mark.parametrize("command", ["validate", "profile-labels", "profile-text", "duplicates", "eda"])
def test_reports(table, tmp_path, command):
    assert run(command, table, tmp_path) == 0
    report = json.loads((tmp_path / f"{command}.json").read_text())
    assert report["command"] == command and report["tables"]
    assert run(command, table, tmp_path) == 2  # outputs exist
    assert run(command, table, tmp_path, "--force") == 0


def test_consolidated_report(spark, table, tmp_path):
    for command in ("validate", "profile-labels", "profile-text", "duplicates", "near-duplicates", "eda"):
        assert run(command, table, tmp_path / command) == 0
    assert run("report", str(tmp_path), tmp_path / "out") == 0
    s = json.loads((tmp_path / "out" / "summary.json").read_text())
    assert s["dataset"]["rows"] == 40 and s["quality"]["null_label_cells"] == 0 and len(s["labels"]["aspects"]) == len(ASPECTS)
    assert s["duplicates"]["exact"][0]["duplicate_groups"] == 1 and len(s["samples"]["median_samples"]) == 20
    text = (tmp_path / "out" / "report.md").read_text()
    assert [x for x in text.splitlines() if x.startswith("## ")][:4] == ["## Data", "## Quality", "## Labels", "## Text lengths"] and "## Policy" in text
    other = str(tmp_path / "other")
    spark.read.parquet(table).limit(30).write.parquet(other)
    assert run("validate", other, tmp_path / "validate", "--force") == 0
    assert run("report", str(tmp_path), tmp_path / "out2") == 2  # the reports speak of different rows


def test_listed_groups_and_csv_input(spark, table, tmp_path):
    (tmp_path / "groups.csv").write_text("split,member_ids\ntrain,1|2\ntrain,2|5\n")
    source = str(tmp_path / "t.csv")
    spark.read.parquet(table).toPandas().to_csv(source, index=False)
    assert run("preprocess", source, tmp_path / "p", "--groups", str(tmp_path / "groups.csv"), "--near") == 0
    got = spark.read.parquet(str(tmp_path / "p" / "interim")).select("source_id", "group_id").collect()
    by = {}
    for r in got:
        by.setdefault(r.group_id, set()).add(r.source_id)
    assert {1, 2, 5} in by.values() and len(got) == 40


def test_a_changed_table_is_not_the_pinned_one(spark, table, tmp_path):
    path = str(tmp_path / "t")
    spark.read.parquet(table).write.parquet(path)
    meta = str(tmp_path / "meta.json")
    assert cli.main(["pin", "--input", path, "--output", meta]) == 0 and run("validate", meta, tmp_path / "a") == 0
    spark.read.parquet(table).limit(39).write.mode("overwrite").parquet(path)
    assert run("validate", meta, tmp_path / "b") == 2 and run("validate", meta, tmp_path / "b", "--no-verify") == 0


def test_invalid_table_and_missing_input(spark, table, tmp_path):
    bad = str(tmp_path / "bad")
    spark.read.parquet(table).drop("size").write.parquet(bad)
    assert run("validate", bad, tmp_path / "o") == 1
    assert run("validate", str(tmp_path / "none"), tmp_path / "o2") == 2


def test_from_raw_to_checked_split(spark, table, tmp_path):
    assert cli.main(["pin", "--input", table, "--output", str(tmp_path / "meta.json")]) == 0
    assert run("preprocess", str(tmp_path / "meta.json"), tmp_path / "p") == 0
    interim = str(tmp_path / "p" / "interim")
    assert spark.read.parquet(interim).select("group_id").distinct().count() == 39
    assert run("split", interim, tmp_path / "s") == 0
    member = str(tmp_path / "s" / "membership")
    assert run("check-splits", interim, tmp_path / "c", "--membership", member, "--tolerance", "0.9") == 0
    assert run("check-splits", interim, tmp_path / "c2", "--membership", member, "--tolerance", "0.0") == 2
    assert json.loads((tmp_path / "c2" / "check-splits.json").read_text())["valid"] is False


def test_logging_is_configured_once():
    assert cli.configure_logging() is cli.configure_logging()
    n = len(cli.log.handlers)
    assert len(cli.configure_logging().handlers) == n
