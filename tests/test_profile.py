import statistics

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import eda, profile
from tallyloom.spec import ASPECTS, TableSpec

SCHEMA = "source_id long, row_index long, source_split string, text string, " + ", ".join(f"{a} int" for a in ASPECTS)


def frame(spark, rows):
    return spark.createDataFrame([(i, n, "train", t, *labels) for n, (i, t, *labels) in enumerate(rows)], SCHEMA)


def test_label_counts_and_mentions(spark):
    cols = [(0, 1, 3, None), (3, 0, 2, 0), (0, 0, 0, 0), (2, 0, 1, 0), (0, 3, 0, 0)]
    df = frame(spark, [(i, "t", *[c[i] for c in cols]) for i in range(4)])
    got = {(r.aspect, r.label): r for r in profile.label_distribution(df).collect()}
    assert [got["material", x]["count"] for x in ("0", "1", "2", "3", "missing")] == [1, 1, 0, 1, 1]
    assert got["material", "1"].proportion == 0.25 and got["material", "1"].proportion_among_valid == pytest.approx(1 / 3)
    s = {r.aspect: r for r in profile.label_summary(df).collect()}
    assert (s["material"].mentioned_count, s["material"].mentioned_proportion) == (2, 0.5)
    assert s["material"].mentioned_among_valid == pytest.approx(2 / 3)
    m = profile.mentioned_aspects(df).orderBy("mentioned").collect()
    assert {r.mentioned: r.rows for r in m if r.rows} == {0: 1, 2: 2, 3: 1} and len(m) == 6
    assert m[0].mean_mentioned == 1.75 and m[0].rows_with_missing == 1


def test_text_patterns(spark):
    df = frame(spark, [(10, "Tốt lắm!", *[0] * 5), (11, "Màu  rất bền!!\nẢnh: www.example.org/a", *[0] * 5), (12, "Cảm ơn 😊", *[0] * 5), (13, "Cỡ 38\trộng", *[0] * 5)])
    got = {r.pattern: (r.rows, r.occurrences) for r in profile.pattern_signals(df).collect()}
    for name in ("url", "emoji_like", "tab", "line_break", "repeated_whitespace", "repeated_punctuation"):
        assert got[name][0] == 1, name
    assert got["digit_character"] == (1, 2) and got["non_breaking_space"] == (0, 0)
    top = profile.longest(df).orderBy("rank").first()
    assert top.id == 11 and top.preview == "Màu rất bền!! Ảnh: www.example.org/a"
    stats = {r.metric: r for r in profile.length_statistics(profile.lengths(df)).collect()}
    assert stats["characters"].minimum == 8 and stats["tokens"].minimum == 2


def test_null_and_blank_texts(spark):
    df = frame(spark, [(1, None, *[0] * 5), (2, " \n　", *[0] * 5), (3, "Hợp lý", *[0] * 5)])
    r = profile.text_availability(df).first()
    assert (r.null_text, r.empty_text, r.profiled) == (1, 1, 1)


def test_length_statistics_match_plain_python(spark):
    texts = ["x" * n for n in (1, 2, 2, 3, 5, 8, 13, 40)]
    df = frame(spark, [(i, t, *[0] * 5) for i, t in enumerate(texts)])
    s = {r.metric: r for r in profile.length_statistics(profile.lengths(df)).collect()}["characters"]
    sizes = [len(t) for t in texts]
    assert s["mean"] == statistics.fmean(sizes) and s.standard_deviation == pytest.approx(statistics.pstdev(sizes))
    assert (s.lower_fence, s.upper_outliers, s.lower_outliers) == (0.0, 1, 0)
    t = profile.threshold_counts(profile.lengths(df)).first()
    assert (t.short_characters, t.short_tokens, t.long_characters, t.long_tokens) == (6, 8, 1, 8)


def test_even_sample_goes_by_rank(spark):
    """Gaps in the row column: places are ranks, not values."""
    df = spark.createDataFrame([(10 * i if i < 50 else 1000 + i * i, f"t{i}") for i in range(100)], "row_index long, text string").repartition(7)
    assert sorted(r.text for r in profile.even_sample(df, 4).collect()) == ["t0", "t25", "t50", "t75"]


@pytest.mark.parametrize("k,want", [(4, [0, 2, 5, 7]), (10, list(range(10))), (99, list(range(10))), (1, [0])])
def test_even_sample(spark, k, want):
    df = spark.range(10).withColumnRenamed("id", "row_index")
    assert sorted(r.row_index for r in profile.even_sample(df, k).collect()) == want
    with pytest.raises(ValueError):
        profile.even_sample(df, 0)


def test_keys_and_previews(spark):
    assert X.duplicate_key("  ÁO​\tĐẸP  ") == "áo đẹp" != X.duplicate_key("áo đẹp!")
    assert X.duplicate_key("Straße ﬁ") == "strasse fi"
    assert X.review_text("Áo đẹp\r\n\tkhông  bị xù") == "Áo đẹp không bị xù"
    assert X.review_text("ß A​") == "ß A​"
    for x in ("  a　B ", "ﬁ x", "😊 ok"):
        assert X.review_text(X.review_text(x)) == X.review_text(x)
        assert X.duplicate_key(X.duplicate_key(x)) == X.duplicate_key(x)
    df = spark.createDataFrame([("a" * 156 + "  " + "b" * 20,), ("x  y",), ("w" * 176 + " " + "z" * 9,)], "t string")
    p = [r[0] for r in df.select(X.preview(df.t)).collect()]
    assert p[0] == "a" * 156 + " ..." and p[1] == "x y"
    assert df.select(X.preview(df.t, 180, strip=True)).collect()[2][0] == "w" * 176 + "..."


def test_white_space_class_is_that_of_python(spark):
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, chr(c)) for c in points], "c int, t string")
    got = {r.c for r in df.where(X.is_blank(df.t)).collect()}
    assert got == {c for c in points if chr(c).isspace()}


def test_samples(spark):
    rows = [(1, "Mẫu XK-7 mặc thoải mái.", 0, 1, 2, 3, 0), (2, "Vải tốt, may kém, giá hơi chát.", 1, 2, 3, 0, 2), (3, "Chật vai, ship lâu.", 2, 3, 0, 1, 3), (4, "Tạm được.", 3, 0, 1, 2, 1)]
    df = frame(spark, rows)
    assert eda.median_samples(df).count() == 20
    mixed = eda.mixed_samples(df).collect()
    assert mixed[0].id == 2 and mixed[0].mentioned == 4
    assert [r.id for r in eda.product_code_samples(df).collect()] == [1]
    assert sum(r.n for r in eda.length_histogram(df).where("metric = 'characters'").collect()) == 3  # the longest lies above the 99th percentile
    with pytest.raises(ValueError):
        eda.require_aligned({"a": {"split": "train", "rows": 4, "digest": "1"}, "b": {"split": "train", "rows": 4, "digest": "2"}})
    assert "a\\|b c" in eda.markdown("T", {"S": [{"k": "a|b\nc"}]})


def test_spec_defaults():
    assert TableSpec().labels.columns == ASPECTS


ODD = [
    "", " ", "a\r\nb\rc\n\n", "\r", "\r\n", "x  y\t\tz \t", "!?! .,; a.b ..", "www.a.b HTTPS://x y_http://no zhttp://no Http://", "WWW.\u017f http\u017f://x", "12\u00b2\u2460\u0663 \u2167", "\u00a0\u202f\u200b\ufeff",
    "\U0001f600\u2600\u20e3\U0001f1fb", "\u00bfqu\u00e9? \u00ab\u2026\u00bb \u3001", "\x1c\x85\u2028 a\x0bb", "\0\0 \t", "\u0130\u0345 \U00020000!!",
]


def test_sizes_and_signals_are_those_of_the_patterns(spark):
    df = spark.createDataFrame(list(enumerate([*ODD, None] * 40)), "i long, text string").repartition(2)
    t = F.col("text")
    got = df.select("i", X.sizes_of(t).alias("s"), X.pattern_counts_of(t).alias("c"), X.keyed_of(t).alias("k"))
    got = got.select("i", "s.*", "c.*", "k.tokens", F.sha2("k.norm", 256).alias("g")).orderBy("i").collect()
    norm = X.duplicate_key_of(t)
    want = df.select("i", X.token_count(t), X.line_count(t), *[X.count_of(t, p) for p in X.PATTERNS.values()], X.count_of(norm, X.WORD + "+"), X.duplicate_key_digest_of(t)).orderBy("i").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(got) == 40 * (len(ODD) + 1)


@pytest.mark.parametrize("of", [lambda df: profile.threshold_counts(profile.lengths(df)), lambda df: profile.length_statistics(profile.lengths(df)), eda.length_histogram])
def test_texts_are_read_once(spark, of):
    """What is left to run after the lengths are counted does not go back to the texts."""
    df = spark.range(20).select(F.col("id").alias("source_id"), F.col("id").alias("row_index"), F.lit("train").alias("source_split"), F.repeat(F.lit("a "), F.col("id").cast("int")).alias("text"))
    plan = of(df)._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "Arrow" not in plan
