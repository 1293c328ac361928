import difflib
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.text import duplicate_key
from tallyloom.functions.similarity import LongestMatch, features, jaccard, sequence_ratio, simhash, trigrams
from tallyloom.operators import exact, near
from tallyloom.operators.graph import connected_components, union_find
from tallyloom.spec import ASPECTS, NearSpec, TableSpec

SCHEMA = "source_id long, row_index long, source_split string, text string, " + ", ".join(f"{a} int" for a in ASPECTS)


def frame(spark, rows):
    return spark.createDataFrame([(i, n, "train", t, *labels) for n, (i, t, *labels) in enumerate(rows)], SCHEMA)


def test_exact_groups(spark):
    z = (0, 0, 0)
    df = frame(spark, [(1, "Áo  ĐẸP", 3, *z, 0), (2, "  áo đẹp ", 3, *z, 0), (3, "Vải ổn", 2, *z, None), (4, "Vải ổn", 1, *z, 0), (5, "Khác", 0, *z, 0)])
    raw = exact.raw_summary(df).first()
    assert (raw.unique_texts, raw.duplicate_groups, raw.members, raw.redundant) == (4, 1, 2, 1)
    s = exact.normalized_summary(df).first()
    assert (s.unique_texts, s.duplicate_groups, s.members, s.merged_groups, s.conflict_groups, s.mixed_missing_groups, s.consistent_groups) == (3, 2, 4, 1, 1, 1, 1)
    g = exact.ordered(exact.groups(df)).collect()
    assert g[0].conflicting == ["material"] and g[0].mixed_missing == ["service"] and g[0].first_row == 2
    assert g[1].raw_variants == 2 and sorted(r.id for r in exact.members(df).collect()) == [1, 2, 3, 4]


def test_texts_of_different_splits_are_not_grouped(spark):
    df = spark.createDataFrame([(1, 0, "a", "same", *[0] * 5), (2, 1, "b", "same", *[0] * 5)], SCHEMA)
    assert exact.groups(df).count() == 0


def test_null_text_is_refused(spark):
    with pytest.raises(ValueError):
        exact.require_text(frame(spark, [(1, None, *[0] * 5)]), TableSpec())


BASE = "Áo khoác màu xanh mặc rất ấm nhưng tay hơi dài. Đường may chắc chắn, vải dày dặn và không ra màu khi giặt lần đầu."
LIKE = "Áo khoác màu xanh mặc rất ấm nhưng tay hơi rộng. Đường may chắc chắn, vải dày dặn và không ra màu khi giặt lần đầu."
OTHER = "Giày đi êm chân, hộp bị móp lúc nhận hàng, nhân viên trả lời tin nhắn chậm mất hai ngày liền."


def test_near_pairs_and_clusters(spark):
    df = frame(spark, [(1, BASE, 0, 0, 1, 1, 3), (2, LIKE, 0, 0, 2, 1, 3), (3, BASE, 0, 0, 1, 1, 3), (4, OTHER, 3, 3, 0, 0, 3), (5, "quá ngắn", *[0] * 5)])
    got = near.analyze(df, near=NearSpec(bands=16, band_bits=4, max_hamming=32))
    pairs = got["pairs"].collect()
    assert {(r.first_id, r.second_id) for r in pairs} == {(1, 2), (2, 3)}  # the equal pair and the unrelated one are out
    assert all(r.conflicting == ["size"] and r.confidence == "high_confidence" for r in pairs)
    c = got["clusters"].collect()
    assert len(c) == 1 and (c[0].member_count, c[0].edge_count, c[0].cluster_id, c[0].conflicting) == (3, 2, hashlib.sha256(b"1|2|3").hexdigest(), ["size"])
    s = got["summary"].first()
    assert (s.rows, s.eligible, s.excluded, s.verified_pairs, s.clusters, s.clustered_rows) == (5, 4, 1, 2, 1, 3)
    assert got["candidates"].where("second_row = 1").count() == 1 and s.candidate_pairs >= 3  # the equal texts count too


def test_pairs_of_copies_are_scored_in_row_order(spark):
    texts = [BASE, LIKE, BASE, LIKE.upper(), OTHER, BASE.replace("ấm", "lạnh")]
    got = near.analyze(frame(spark, [(i, t, *[0] * 5) for i, t in enumerate(texts)]), near=NearSpec(bands=64, band_bits=1, max_hamming=64))
    norms, want = [duplicate_key(t) for t in texts], {}
    for i, a in enumerate(norms):
        for j in range(i + 1, len(norms)):
            b = norms[j]
            if a != b and min(len(a), len(b)) / max(len(a), len(b)) >= 0.65 and jaccard(trigrams(a), trigrams(b)) >= 0.6:
                want[i, j] = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    assert {(r.first_row, r.second_row): r.sequence_ratio for r in got["pairs"].collect()} == want and len(want) == 8
    s = got["summary"].first()
    assert s.candidate_pairs == 15 and s.verified_pairs == 8 and s.clustered_rows == 5


def skewed_ratio(a, b, most):
    """A ratio that depends on the order of most pairs."""
    return F.when(F.conv(F.substring(F.sha2(F.concat(a, F.lit("/"), b), 256), 1, 1), 16, 10).cast("int") < 6, 0.78).otherwise(0.9)


@pytest.mark.parametrize("ratio", [skewed_ratio, lambda a, b, most: F.lit(0.9)])
def test_clusters_and_counts_from_text_pairs_are_those_of_row_pairs(spark, ratio):
    rng = random.Random(5)
    families = [[f"{BASE[:60]} {k} {x} {BASE[60:]}" for x in ("một", "hai", "ba", "bốn")] for k in ("đỏ đô thẫm vừa mua hôm qua ở chợ", "tím")]
    rows = [(i, rng.choice(rng.choice(families)), *[rng.choice([0, 1, None]) for _ in range(5)]) for i in range(60)]
    got = near.analyze(frame(spark, rows), near=NearSpec(bands=64, band_bits=1, max_hamming=64, review=(0.5, 0.75), high=(0.5, 0.82)), ratio=ratio)
    pairs = got["pairs"].cache()
    prep, members = got["prepared"], near.cluster_members(pairs)
    assert sorted(map(tuple, got["members"].collect())) == sorted(map(tuple, members.collect()))
    high = pairs.where("confidence = 'high_confidence'").withColumn("edges", F.lit(1))
    assert sorted(got["clusters"].collect()) == sorted(near.clusters(high, prep, TableSpec(), members).collect())
    s, every = got["summary"].first(), pairs.collect()
    assert (s.verified_pairs, s.high_pairs, s.conflict_pairs) == (len(every), sum(r.confidence == "high_confidence" for r in every), sum(bool(r.conflicting) for r in every))
    assert len(every) > 500


def test_clusters_of_hot_texts_form_no_row_pairs(spark):
    """Two like texts of 50,000 rows each: 2.5 * 10^9 pairs of rows, counted and clustered from one pair of texts."""
    n = 50_000
    df = spark.range(2 * n).select(F.col("id").alias("source_id"), F.col("id").alias("row_index"), F.lit("train").alias("source_split"), F.when(F.col("id") % 2 == 0, F.lit(BASE)).otherwise(F.lit(LIKE)).alias("text"), *[(F.col("id") % 3).cast("int").alias(a) for a in ASPECTS])
    got = near.analyze(df, near=NearSpec(bands=16, band_bits=4, max_hamming=32))
    s = got["summary"].first()
    assert (s.verified_pairs, s.high_pairs, s.clusters, s.clustered_rows) == (n * n, n * n, 1, 2 * n)
    equal = [sum(i % 3 == k for i in range(side, 2 * n, 2)) for k in range(3) for side in (0, 1)]
    assert s.conflict_pairs == n * n - sum(equal[2 * k] * equal[2 * k + 1] for k in range(3))
    assert [(c.member_count, c.edge_count) for c in got["clusters"].collect()] == [(2 * n, n * n)]


def test_cluster_scores(spark):
    pairs = spark.createDataFrame([("train", 0, 1, 0.8, 0.9, "high_confidence"), ("train", 1, 2, 0.85, 0.91, "high_confidence"), ("train", 4, 5, 0.65, 0.8, "needs_review")], "split string, first_row long, second_row long, jaccard double, sequence_ratio double, confidence string")
    prep = near.prepared(frame(spark, [(i, BASE, *[0] * 5) for i in range(6)]))
    high = pairs.where("confidence = 'high_confidence'").withColumn("edges", F.lit(1))
    c = near.clusters(high, prep, TableSpec(), near.cluster_members(pairs)).collect()
    assert [(r.member_count, r.edge_count, r.min_jaccard, r.min_sequence_ratio) for r in c] == [(3, 2, 0.8, 0.9)]


def test_simhash():
    a, b, empty = simhash(["áo cotton mềm và đẹp", "áo cotton mềm và đẹp", ""])
    assert a == b and empty == -1  # ties set the bit
    assert [len(trigrams(x)) for x in ("abcd", "ab", "", "aaaa")] == [2, 1, 0, 1]
    assert jaccard(trigrams("abcd"), trigrams("abce")) == 1 / 3 and jaccard(trigrams(""), trigrams("")) == 0.0 and jaccard(trigrams("ab"), trigrams("ab")) == 1.0
    assert features("a b c") == {"a", "b", "c", "a␟b", "b␟c"}


def test_sequence_ratio_is_that_of_difflib(monkeypatch):
    rng = random.Random(3)
    assert sequence_ratio("tide", "diet") == 0.25 and sequence_ratio("diet", "tide") == 0.5 and sequence_ratio("", "") == 1.0
    monkeypatch.setattr("tallyloom.functions.similarity.SMALL", 8)
    for _ in range(60):
        a = "".join(rng.choice("abc é") for _ in range(rng.randint(0, 60)))
        b = a[: rng.randint(0, 60)] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        assert sequence_ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        assert LongestMatch(a, b).find(0, len(a), 0, len(b))[2] == m.size


@pytest.mark.parametrize("limit", [0, 1000])
def test_components_are_the_transitive_closure(spark, limit):
    rng = random.Random(limit)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)]
    want = dict(union_find(edges))
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    assert {r.node: r.component for r in connected_components(df, driver_edges=limit).collect()} == want
    assert connected_components(df.limit(0), driver_edges=limit).count() == 0


@pytest.mark.parametrize("seed,pairs", [(2, 1 << 20), (3, 30), (8, 1 << 20)])
def test_sequence_ratio_from_long_blocks_is_that_of_difflib(monkeypatch, seed, pairs):
    monkeypatch.setattr("tallyloom.functions.similarity.SMALL", 8)
    monkeypatch.setattr("tallyloom.functions.similarity.SEED", seed)
    monkeypatch.setattr("tallyloom.functions.similarity.SEED_PAIRS", pairs)
    rng = random.Random(seed)
    for _ in range(120):
        a = "".join(rng.choice("abc é") for _ in range(rng.randint(0, 90)))
        b = a[: rng.randint(0, 90)] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) + a[rng.randint(0, 90) :]
        for x, y in ((a, b), (b, a), ("ab" * 40, "ab" * 30 + b)):
            assert sequence_ratio(x, y) == difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()


def test_sequence_ratio_looks_for_long_blocks_once(monkeypatch):
    """Near copies are cut along blocks found in one look, not by a search of all lengths for each."""
    calls, find = [], LongestMatch.find
    monkeypatch.setattr(LongestMatch, "find", lambda self, *x: calls.append(x) or find(self, *x))
    rng = random.Random(9)
    a = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400))
    b = a
    for i in range(40):
        b = b[: i * 60 + 5] + "#" + b[i * 60 + 6 :]
    assert sequence_ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() and len(calls) <= 2
