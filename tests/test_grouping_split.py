import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import identity
from tallyloom.operators import grouping, split
from tallyloom.plans import preprocess
from tallyloom.sources import io
from tallyloom.spec import ASPECTS, SPLITS, TableSpec
from tallyloom.streaming.incremental import validate_stream

LABELS = ", ".join(f"{a} int" for a in ASPECTS)


def rows(spark, items):
    return spark.createDataFrame(items, f"review_id string, {LABELS}")


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def six(spark):
    return rows(spark, [(f"r{i}", m, 0, 0, 0, 0) for i, m in enumerate((0, 0, 0, 3, 3, 0), 1)])


@pytest.mark.parametrize("shuffled", [False, True])
def test_groups_join_exact_and_near_evidence(spark, shuffled):
    df = six(spark).orderBy(F.desc("review_id")) if shuffled else six(spark)
    out = grouping.assign_groups(df, {"exact": edges(spark, ("r1", "r2")), "high_confidence_near": edges(spark, ("r2", "r3"), ("r4", "r5"))})
    g = {r.review_id: r for r in out.collect()}
    assert g["r1"].group_id == g["r2"].group_id == g["r3"].group_id == "group_6d49aac03d16b058af4946ad4ba4b5fc9bb6c0b95f632eab0c4b4d3235434a03"
    assert g["r4"].group_id == g["r5"].group_id != g["r1"].group_id != g["r6"].group_id
    assert g["r1"].evidence == ["exact", "high_confidence_near"] and g["r6"].evidence == [] and g["r6"].group_size == 1
    s = grouping.summary(out).first()
    assert (s.rows, s.groups, s.multi_member_groups, s.conflict_groups) == (6, 3, 2, 0)


@pytest.mark.parametrize("policy,flags,excluded,held", [("retain", (True, False), 0, 0), ("exclude", (False, False), 2, 0), ("manual_review", (False, True), 0, 2)])
def test_conflict_policies(spark, policy, flags, excluded, held):
    df = rows(spark, [("r1", 1, None, 0, 0, 0), ("r2", 3, 2, 0, 0, 0)])
    out = grouping.assign_groups(df, {"exact": edges(spark, ("r1", "r2"))}, policy)
    r = out.first()
    assert (r.retain_for_processing, r.requires_manual_review) == flags
    assert r.group_conflicting_label_columns == ["material"] and r.group_mixed_missing_label_columns == ["design"]
    s = grouping.summary(out).first()
    assert (s.excluded_rows, s.manual_review_rows) == (excluded, held)


def test_mixed_missing_alone_is_no_conflict(spark):
    out = grouping.assign_groups(rows(spark, [("r1", 1, None, 0, 0, 0), ("r2", 1, 2, 0, 0, 0)]), {"exact": edges(spark, ("r1", "r2"))}, "exclude")
    assert out.where("retain_for_processing").count() == 2


def test_bad_rows_and_evidence(spark):
    ok = six(spark)
    for bad in (ok.union(ok), ok.withColumn("review_id", F.lit(" r")), ok.withColumn("material", F.lit(9))):
        with pytest.raises(ValueError):
            grouping.assign_groups(bad, {})
    member = "g int, review_id string"
    for items in ([(1, "r1")], [(1, "r1"), (1, "zz")], [(1, "r1"), (1, "r1")]):
        with pytest.raises(ValueError):
            grouping.check_evidence(ok, spark.createDataFrame(items, member), ["g"])
    with pytest.raises(ValueError):
        grouping.policy_flags(F.lit(True), "perhaps")


def test_ids(spark):
    df = spark.createDataFrame([("train", 42)], "s string, i long")
    one = df.select(identity.review_id(df.s, df.i, "data", "rev")).first()[0]
    import hashlib

    body = '{"dataset_name":"data","dataset_revision":"rev","schema_version":"v1","source_id":"42","source_split":"train"}'
    assert one == "review_" + hashlib.sha256(body.encode()).hexdigest()
    assert df.select(identity.review_id(df.s, df.i.cast("string"), "data", "rev")).first()[0] == one
    assert df.select(identity.review_id(df.s, df.i, "data", "other")).first()[0] != one
    for args in ((" ", "r"), ("d", "")):
        with pytest.raises(ValueError):
            identity.require_identity(df, *args, "s", "i")
    for bad in (df.withColumn("s", F.lit(None).cast("string")), df.withColumn("i", F.lit(" ")), df.withColumn("i", F.lit(1.5))):
        with pytest.raises(ValueError):
            identity.require_identity(bad, "d", "r", "s", "i")
    with pytest.raises(ValueError, match="collision"):
        identity.require_unique(spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), "k", ["v"])
    with pytest.raises(ValueError, match="duplicate"):
        identity.require_unique(spark.createDataFrame([("a", 1), ("a", 1)], "k string, v int"), "k", ["v"])


def reference_greedy(groups, ratios, width):
    """Scores every state from scratch."""
    n, totals = sum(r for r, _ in groups), [sum(c[k] for _, c in groups) for k in range(width)]
    have, counts, out = {s: 0 for s in SPLITS}, {s: [0] * width for s in SPLITS}, []
    for size, own in groups:
        scored = []
        for i, s in enumerate(SPLITS):
            h = {t: have[t] + (size if t == s else 0) for t in SPLITS}
            c = {t: [x + (y if t == s else 0) for x, y in zip(counts[t], own)] for t in SPLITS}
            a = 0.0
            for t in SPLITS:
                a += ((h[t] - n * ratios[t]) / max(n, 1)) ** 2
            b, terms = 0.0, 0
            for k in range(width):
                if totals[k]:
                    for t in SPLITS:
                        b += abs(c[t][k] - totals[k] * ratios[t]) / totals[k]
                        terms += 1
            scored.append((4.0 * a + (b / terms if terms else b), i, h, c))
        _, i, have, counts = min(scored, key=lambda x: x[:2])
        out.append(i)
    return out


def test_greedy_scores():
    rng = random.Random(1)
    for _ in range(10):
        groups = [(rng.randint(1, 4), [rng.randint(0, 3) for _ in range(6)]) for _ in range(30)]
        ratios = split.normalized_ratios({"train": 7, "validation": 2, "test": 1})
        assert split.greedy(groups, ratios) == reference_greedy(groups, ratios, 6)
    with pytest.raises(ValueError):
        split.normalized_ratios({"train": 1.0, "validation": 0.0, "test": 1.0})


def split_input(spark):
    items = [(f"r{i:02d}", f"g{i:02d}", f"text {i}", i % 4, (i + 1) % 4, 0, 1, 2) for i in range(10)]
    items += [("r10", "g_dup", "dup", 1, 1, 1, 1, 1), ("r11", "g_dup", "dup", 1, 1, 1, 1, None)]
    return spark.createDataFrame(items, f"review_id string, group_id string, text string, {LABELS}")


def test_group_aware_split(spark):
    df = split_input(spark)
    got = {r.review_id: r.split for r in split.assign_splits(df).collect()}
    assert set(got.values()) == set(SPLITS) and got["r10"] == got["r11"]
    again = {r.review_id: r.split for r in split.assign_splits(df.orderBy(F.desc("review_id")).repartition(3)).collect()}
    assert again == got
    blocks = {r.review_id: r.split for r in split.assign_splits(df, driver_groups=4).collect()}
    assert set(blocks) == set(got) and blocks["r10"] == blocks["r11"]
    m = split.joined(df, split.assign_splits(df))
    assert sum(r.rows for r in split.split_summary(m).collect()) == 12
    with pytest.raises(ValueError):
        split.joined(df, split.assign_splits(df).limit(5))


def test_split_is_one_greedy_pass_at_every_size(spark):
    """More groups than driver_groups, one of them with a third of all rows."""
    rng = random.Random(3)
    items = [(f"r{i:03d}", "big" if i < 100 else f"g{i}", f"text {i}", *(rng.randrange(4) for _ in range(5))) for i in range(300)]
    df = spark.createDataFrame(items, f"review_id string, group_id string, text string, {LABELS}")
    got = {r.review_id: r.split for r in split.assign_splits(df, driver_groups=20).collect()}
    groups = sorted(split.group_summaries(df).collect(), key=lambda r: (-r.row_count, r.order_key, r.group_id))
    width = len(groups[0]) - 3
    want = reference_greedy([(r.row_count, [r[f"k{k}"] for k in range(width)]) for r in groups], split.normalized_ratios(), width)
    by = {r.group_id: SPLITS[s] for r, s in zip(groups, want)}
    assert got == {x[0]: by[x[1]] for x in items}


def test_split_checks(spark):
    items = [(f"{s}{x}", f"g{s}{x}", f"text {s} {x}", x, x, x, x, x, s) for s in SPLITS for x in range(4)]
    df = spark.createDataFrame(items, f"review_id string, group_id string, text string, {LABELS}, split string")
    member = df.select("review_id", "group_id", "split")
    assert split.check(df.drop("split"), member).count() == 0
    assert [r.rows for r in split.split_summary(df).orderBy("split").collect()] == [4, 4, 4]
    leaky = df.withColumn("group_id", F.when(F.col("review_id").isin("train0", "test0"), "shared").otherwise(F.col("group_id")))
    leaky = leaky.withColumn("text", F.when(F.col("review_id") == "train1", "  same\ntext ").when(F.col("review_id") == "test1", "same text").otherwise(F.col("text")))
    leaky = leaky.withColumn("material", F.when(F.col("split") == "train", 3).otherwise(0))
    got = {r.code for r in split.check(leaky.drop("split"), leaky.select("review_id", "group_id", "split")).collect()}
    assert got == {"group_id_crosses_splits", "normalized_exact_duplicate_crosses_splits", "label_distribution_drift_exceeds_tolerance"}
    with pytest.raises(ValueError):
        split.drift(df, tolerance=-1)
    codes = {r.code for r in split.contract_issues(df.drop("split"), member.where("split <> 'test'")).collect()}
    assert codes == {"missing_split_review_id", "empty_split"}


def raw(spark, material=0.0):
    schema = "source_id long, row_index long, source_split string, text string, " + ", ".join(f"{a} double" for a in ASPECTS)
    return spark.createDataFrame([(i, i - 1, "train", f"Review {i}", material, 0.0, 0.0, 0.0, None if i == 4 else 0.0) for i in range(1, 5)], schema)


def test_preprocess_end_to_end(spark, tmp_path):
    (tmp_path / "groups.csv").write_text("split,member_ids\ntrain,1|2\ntrain, 2 |3\n")
    df = raw(spark)
    ids = preprocess.interim_rows(df, "data", "rev")
    listed = io.read_groups(spark, str(tmp_path / "groups.csv"))
    out, audit = preprocess.preprocess(df, "data", "rev", {"exact": preprocess.listed_evidence(listed, ids)})
    g = {r.source_id: r.group_id for r in out.collect()}
    assert g[1] == g[2] == g[3] != g[4]
    a = audit.first()
    assert (a.input_rows, a.written_rows, a.missing_label_cells, a.groups) == (4, 4, 1, 2)
    assert sorted(map(tuple, out.select("review_id", "group_id").collect())) == sorted(map(tuple, preprocess.preprocess(df, "data", "rev", {"exact": preprocess.listed_evidence(listed, ids)})[0].select("review_id", "group_id").collect()))
    with pytest.raises(ValueError, match="raw validation"):
        preprocess.preprocess(raw(spark, 4.0), "data", "rev")
    (tmp_path / "one.csv").write_text("split,member_ids\ntrain,1|\n")
    with pytest.raises(ValueError):
        io.read_groups(spark, str(tmp_path / "one.csv"))


def test_sources_and_sinks(spark, tmp_path):
    df = raw(spark)
    io.write_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception):
        io.write_table(df, str(tmp_path / "t"))
    meta = io.write_metadata(df, "source_split", "data", "rev", str(tmp_path / "t"), tmp_path / "meta.json")
    assert meta["total_rows"] == 4 and io.open_pinned(spark, tmp_path / "meta.json", "source_split", verify=True).count() == 4
    io.write_table(df.limit(3), str(tmp_path / "t"), force=True)
    with pytest.raises(ValueError):
        io.open_pinned(spark, tmp_path / "meta.json", "source_split", verify=True)
    with pytest.raises(FileExistsError):
        io.guard([tmp_path / "meta.json"])
    io.guard([tmp_path / "meta.json"], force=True)
    (tmp_path / "list.json").write_text("[]")
    with pytest.raises(TypeError):
        io.read_json(tmp_path / "list.json")
    assert io.write_json(tmp_path / "x.json", {"é": 1}) == io.file_sha256(tmp_path / "x.json")
    text = spark.createDataFrame([(' NA "q"\nline ', ["a", "b"])], "t string, l array<string>")
    io.write_csv(text, str(tmp_path / "c"))
    back = io.read_csv(spark, str(tmp_path / "c"), "t string, l string").first()
    assert (back.t, back.l) == (' NA "q"\nline ', "a|b")


def test_validation_of_a_stream(spark, tmp_path):
    df = raw(spark)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = validate_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), TableSpec())
    q.awaitTermination(120)
    assert {r.code for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"null_label"}


def test_group_has_one_digest_where_a_join_below_is_replanned(spark):
    """The join becomes a broadcast one as it runs, whose output is no longer spread by the group."""
    members = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("r"), F.lpad((F.col("id") % 1000).cast("string"), 4, "0")).alias("root"), F.concat(F.lit("m"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("review_id")).repartition(8).checkpoint()
    many = members.groupBy("root").count().where("count > 1").select("root").checkpoint()
    sizes = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}  # as for tables that are estimated larger than they are
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        found = identity.group_ids(members.join(many, "root", "left_semi"), "root", "review_id")
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()  # it doesn't rest on the join's own exchange
        got = found.collect()
    finally:
        for k in sizes:
            spark.conf.unset(k)
    by = {}
    for r in members.collect():
        by.setdefault(r.root, []).append(r.review_id)
    body = lambda m: '{"member_review_ids":[' + ",".join(f'"{x}"' for x in sorted(m)) + '],"schema_version":"v1"}'
    assert sorted(map(tuple, got)) == sorted((root, "group_" + hashlib.sha256(body(m).encode()).hexdigest()) for root, m in by.items())


@pytest.mark.parametrize("name", ["split_summary", "split_drift", "split_labels"])
def test_split_tables_hold_no_texts(spark, monkeypatch, name):
    """Texts go through Python once, for the group id, and are not written again with the rows that carry it."""
    from tallyloom.plans import catalog

    kept = []
    monkeypatch.setattr(catalog, "cut", lambda df: kept.append(df.columns) or df.checkpoint())
    assert getattr(catalog, name)(spark, "/root/testdata/sf0.001").count() > 0
    assert kept and not any({"text", "source_text"} & set(c) for c in kept)

