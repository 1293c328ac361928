"""All queries of the library proper and the SQL that each is checked against.

The reviews view gives `documents` the shape of a labelled review table: lang is the source split,
doc_id the id and row number, and five aspect labels follow from `labels` and the row's numbers, so
that all four classes and nulls occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import identity
from tallyloom.functions import text as X
from tallyloom.functions.similarity import sha2_64
from tallyloom.operators import eda, exact, grouping, near, profile, split, validate
from tallyloom.operators.graph import cut
from tallyloom.plans import preprocess
from tallyloom.plans.oracles import ORACLES
from tallyloom.sources import io
from tallyloom.spec import ASPECTS, NearSpec, TableSpec

SPEC = TableSpec()
NAME, REVISION = "documents", "r1"
NATIVE = NearSpec(max_hamming=16)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = io.read_table(spark, f"{sf_dir}/documents.parquet"), read(spark, sf_dir, "labels")
    d = F.col("doc_id")
    aspects = {
        "material": F.col("quality") + 2 * F.col("toxic"),
        "design": F.when(d % 7 != 0, d % 4),
        "size": F.floor(d / 4) % 4,
        "price": F.length("text") % 4,
        "service": F.when(d % 5 != 4, d % 5),
    }
    return docs.join(labels, "doc_id", "left").select(d.alias("source_id"), d.alias("row_index"), F.col("lang").alias("source_split"), "text", *[c.cast("int").alias(a) for a, c in aspects.items()])


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with planted faults: null and blank texts, fractions, values out of range, an extra column."""
    r = reviews(spark, sf_dir)
    i = F.col("source_id")
    text = F.when(i % 41 == 1, F.lit(None)).when(i % 43 == 2, F.lit(" \t\n")).otherwise(F.col("text"))
    material = F.when(i % 37 == 3, F.lit(1.5)).when(i % 31 == 4, F.lit(7.0)).otherwise(F.col("material").cast("double"))
    return r.withColumns({"source_id": F.when(i % 47 != 5, i), "text": text, "material": material, "note": F.lit("x")})


def listed(c: str):
    return F.concat_ws("|", c).alias(c)


def validate_issue_counts(spark, sf):
    out = validate.validate_raw(dirty(spark, sf), SPEC, samples=False)
    return out.where("code NOT LIKE 'duplicate%'").select("split", "code", "severity", F.coalesce("column", F.lit("-")).alias("column_name"), F.col("count").alias("n"))


def validate_issue_samples(spark, sf):
    out = validate.validate_raw(dirty(spark, sf), SPEC).where("code IN ('null_review', 'empty_review', 'non_integer_label')")
    return out.select("split", "code", F.concat_ws("|", F.transform("sample_rows", lambda x: x.cast("string"))).alias("sample_rows"))


def validate_status(spark, sf):
    return validate.status(validate.validate_raw(reviews(spark, sf), SPEC, samples=False))


def validate_duplicate_rows(spark, sf):
    return validate.duplicate_rows(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_shipdate", "l_quantity"], ["l_returnflag"]).withColumnRenamed("count", "n")


def validate_duplicate_text(spark, sf):
    return validate.duplicate_rows(reviews(spark, sf), ["text"], ["source_split"]).withColumnRenamed("count", "n")


def processed_contract(spark, sf):
    r = reviews(spark, sf)
    i = F.col("source_id")
    p = r.withColumns({"review_id": F.concat(F.lit("r"), F.when(i % 29 == 1, i - 1).otherwise(i).cast("string")), "group_id": F.when(i % 23 != 2, F.concat(F.lit("g"), i.cast("string"))).otherwise(F.lit(" ")), "split": F.when(i % 19 == 3, F.lit("dev")).when(i % 3 == 0, F.lit("train")).otherwise(F.lit("test")), "material": F.when(i % 37 == 3, F.lit(1.5)).when(i % 31 == 4, F.lit(7.0)).otherwise(F.col("material").cast("double"))})
    return validate.validate_processed(p, TableSpec(id="review_id", split="split"), samples=False).select("code", "severity", F.coalesce("column", F.lit("-")).alias("column_name"), F.col("count").alias("n"))


def label_rollup(spark, sf):
    return validate.label_rollup(validate.validate_raw(dirty(spark, sf), SPEC, samples=False))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def label_distribution(spark, sf):
    return rounded(profile.label_distribution(reviews(spark, sf), SPEC))


def label_missing(spark, sf):
    return rounded(profile.label_summary(reviews(spark, sf), SPEC))


def mentioned_aspects(spark, sf):
    return rounded(profile.mentioned_aspects(reviews(spark, sf), SPEC))


def text_availability(spark, sf):
    return profile.text_availability(dirty(spark, sf), SPEC)


def length_percentiles(spark, sf):
    return rounded(profile.length_percentiles(profile.lengths(reviews(spark, sf), SPEC)))


def length_fences(spark, sf):
    return rounded(profile.length_statistics(profile.lengths(reviews(spark, sf), SPEC)))


def threshold_counts(spark, sf):
    return profile.threshold_counts(profile.lengths(reviews(spark, sf), SPEC))


def longest_documents(spark, sf):
    return profile.longest(reviews(spark, sf), SPEC)


def pattern_signals(spark, sf):
    return rounded(profile.pattern_signals(reviews(spark, sf), SPEC))


def conversation_lengths(spark, sf):
    turns = read(spark, sf, "conversations")
    spec = TableSpec(id="conv_id", split="role", row="turn")
    return rounded(profile.length_percentiles(profile.lengths(turns, spec)))


def exact_raw_summary(spark, sf):
    return exact.raw_summary(reviews(spark, sf), SPEC)


def exact_norm_summary(spark, sf):
    return exact.normalized_summary(reviews(spark, sf), SPEC)


def exact_groups(spark, sf):
    return exact.groups(reviews(spark, sf), SPEC).select("split", "group_id", "member_count", "redundant", "raw_variants", listed("conflicting"), listed("mixed_missing"), "first_row")


def exact_members(spark, sf):
    return exact.members(reviews(spark, sf), SPEC).select("split", "group_id", F.col("row").alias("row_no"), "id")


def exact_label_conflicts(spark, sf):
    return exact.groups(reviews(spark, sf), SPEC).select("split", F.explode("conflicting").alias("aspect")).groupBy("split", "aspect").agg(F.count("*").alias("groups"))


def native_signatures(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Distinct texts and their SHA-256 signatures, which SQL can reproduce."""
    texts = cut(near.distinct_texts(near.prepared(reviews(spark, sf), SPEC), NATIVE))
    return texts, cut(near.signatures(texts, sha2_64))


def near_signatures(spark, sf):
    return native_signatures(spark, sf)[1].select("split", F.col("row").alias("row_no"), "n", "sig")


def near_band_matches(spark, sf):
    return near.band_matches(native_signatures(spark, sf)[1], NATIVE)


def near_candidates(spark, sf):
    return near.candidates(native_signatures(spark, sf)[1], NATIVE).withColumn("distance", F.col("distance").cast("long"))


def near_candidate_counts(spark, sf):
    _, sigs = native_signatures(spark, sf)
    return near.candidate_counts(sigs, near.candidates(sigs, NATIVE))


def near_jaccard(spark, sf):
    texts, sigs = native_signatures(spark, sf)
    return rounded(near.jaccard(near.candidates(sigs, NATIVE), texts, NATIVE).select("split", "first_row", "second_row", "length_ratio", "jaccard"))


def near_pairs(spark, sf):
    got = near.analyze(reviews(spark, sf), SPEC)["pairs"]
    return got.withColumns({c: F.concat_ws("|", c) for c in ("conflicting", "mixed_missing")})


def near_clusters(spark, sf):
    got = near.analyze(reviews(spark, sf), SPEC)["clusters"]
    return got.withColumns({c: F.concat_ws("|", c) for c in ("conflicting", "mixed_missing")})


def near_summary(spark, sf):
    return near.analyze(reviews(spark, sf), SPEC)["summary"]


def native_ratio(a: Column, b: Column, most: int | None) -> Column:
    """Share of the earlier text's words that the later one has: a ratio that depends on the order, like the sequence ratio, and that SQL can reproduce."""
    words = lambda c: F.array_distinct(F.split(c, " "))
    return F.size(F.array_intersect(words(a), words(b))) / F.size(words(a))


def native_near(spark, sf) -> dict[str, DataFrame]:
    return near.analyze(reviews(spark, sf), SPEC, NATIVE, sha2_64, native_ratio)


def near_pairs_native(spark, sf):
    got = native_near(spark, sf)["pairs"].withColumn("distance", F.col("distance").cast("long"))
    return rounded(got.withColumns({c: F.concat_ws("|", c) for c in ("conflicting", "mixed_missing")}))


def near_clusters_native(spark, sf):
    return rounded(native_near(spark, sf)["clusters"].withColumns({c: F.concat_ws("|", c) for c in ("conflicting", "mixed_missing")}))


def near_summary_native(spark, sf):
    return native_near(spark, sf)["summary"]


def interim(spark, sf) -> DataFrame:
    return preprocess.interim_rows(reviews(spark, sf), NAME, REVISION, SPEC)


def interim_projection(spark, sf):
    return interim(spark, sf).select("review_id", "source_split", "source_id", F.sha2("text", 256).alias("text_sha256"), *ASPECTS)


def review_ids(spark, sf):
    return interim(spark, sf).select("source_id", "review_id")


def order_keys(spark, sf):
    return interim(spark, sf).select("review_id", identity.order_key(F.col("review_id"), 42).alias("order_key"))


def native_evidence(spark, sf) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Interim rows with exact evidence and candidate texts at distance up to 3 as near evidence."""
    r, rows = reviews(spark, sf), interim(spark, sf)
    _, sigs = native_signatures(spark, sf)
    close = near.candidates(sigs, NATIVE).where("distance <= 3")
    pairs = close.select("split", F.col("first_row").alias("first_id"), F.col("second_row").alias("second_id"), F.lit("high_confidence").alias("confidence"))
    return rows, {"exact": preprocess.exact_evidence(r, rows, SPEC), "high_confidence_near": preprocess.near_evidence(pairs, rows)}


def group_components(spark, sf):
    rows, evidence = native_evidence(spark, sf)
    return grouping.components(rows, evidence)


def grouped(spark, sf, policy: str = "retain") -> DataFrame:
    rows, evidence = native_evidence(spark, sf)
    return grouping.assign_groups(rows, evidence, policy, SPEC.labels)


def group_ids(spark, sf):
    return grouped(spark, sf).select("review_id", "group_id", "group_size", listed("evidence"))


def group_conflicts(spark, sf):
    return grouped(spark, sf).where("group_size > 1").select("review_id", "group_has_label_conflict", "group_has_mixed_missing_labels", listed("group_conflicting_label_columns"), listed("group_mixed_missing_label_columns"))


def group_policy_flags(spark, sf):
    g = cut(grouped(spark, sf))
    out = None
    for policy in grouping.POLICIES:
        keep, manual = grouping.policy_flags(F.col("group_has_label_conflict"), policy)
        one = g.select(F.lit(policy).alias("policy"), keep.alias("k"), manual.alias("m")).groupBy("policy").agg(F.count_if("k").alias("retained"), F.count_if("m").alias("held"), F.count_if(~F.col("k") & ~F.col("m")).alias("excluded"))
        out = one if out is None else out.union(one)
    return out


def group_summary(spark, sf):
    return grouping.summary(grouped(spark, sf, "exclude"))


def preprocess_audit(spark, sf):
    return preprocess.preprocess(reviews(spark, sf), NAME, REVISION, policy="exclude", spec=SPEC)[1]


def interim_table(spark, sf):
    out = preprocess.preprocess(reviews(spark, sf), NAME, REVISION, policy="manual_review", spec=SPEC)[0]
    return out.drop("source_text", "text").withColumns({c: F.concat_ws("|", c) for c in ("group_conflicting_label_columns", "group_mixed_missing_label_columns")})


def exact_grouped(spark, sf) -> DataFrame:
    """Interim rows grouped by their normalised text over all splits: group_id is its hash."""
    return interim(spark, sf).withColumn("group_id", F.sha2("text", 256))


def split_assignment(spark, sf):
    return split.assign_splits(exact_grouped(spark, sf))


def hash_split(spark, sf):
    return split.hash_splits(exact_grouped(spark, sf))


def merged(spark, sf) -> DataFrame:
    g = cut(exact_grouped(spark, sf).select("review_id", "group_id", *ASPECTS))  # texts are read and hashed once, and stop here
    return cut(split.joined(g, split.hash_splits(g)))


def leaky(spark, sf) -> DataFrame:
    """A split by row, which tears groups apart."""
    return exact_grouped(spark, sf).withColumn("split", F.when(F.col("source_id") % 3 == 0, F.lit("train")).when(F.col("source_id") % 3 == 1, F.lit("validation")).otherwise(F.lit("test")))


def split_summary(spark, sf):
    return rounded(split.split_summary(merged(spark, sf)))


def split_labels(spark, sf):
    return split.split_labels(merged(spark, sf))


def split_drift(spark, sf):
    return rounded(split.drift(merged(spark, sf), tolerance=0.01))


def group_leakage(spark, sf):
    return split.group_leakage(leaky(spark, sf))


def text_leakage(spark, sf):
    return split.text_leakage(leaky(spark, sf))


def faulty_membership(spark, sf) -> tuple[DataFrame, DataFrame]:
    g = cut(exact_grouped(spark, sf).select("review_id", "group_id", "source_id"))
    m = split.hash_splits(g).join(g.select("review_id", "source_id"), "review_id")
    i = F.col("source_id")
    m = m.withColumns({"review_id": F.when(i % 53 == 1, F.concat(F.lit("x"), i.cast("string"))).otherwise(F.col("review_id")), "group_id": F.when(i % 59 == 2, F.lit("g")).otherwise(F.col("group_id")), "split": F.when(i % 61 == 3, F.lit("dev")).otherwise(F.col("split"))})
    return g, m.drop("source_id")


def split_contract_issues(spark, sf):
    return split.contract_issues(*faulty_membership(spark, sf)).withColumnRenamed("count", "n")


def missing_split_ids(spark, sf):
    g, m = faulty_membership(spark, sf)
    return g.join(m, "review_id", "left_anti").select("review_id")


def split_check(spark, sf):
    g = cut(leaky(spark, sf))
    return split.check(g, g, tolerance=0.02).withColumnRenamed("count", "n")


def median_sample(spark, sf):
    return eda.median_samples(reviews(spark, sf), SPEC)


def mixed_sentiment_samples(spark, sf):
    return eda.mixed_samples(reviews(spark, sf), SPEC)


def with_codes(spark, sf) -> DataFrame:
    """Reviews in which some texts carry a product code."""
    i = F.col("source_id")
    code = F.when(i % 9 == 1, F.concat(F.lit(" AB-"), i.cast("string"))).when(i % 9 == 2, F.lit(" ABC")).when(i % 9 == 3, F.lit(" 12-34")).when(i % 9 == 4, F.lit(" A1x")).otherwise(F.lit(""))
    return reviews(spark, sf).withColumn("text", F.concat("text", code))


def product_code_rows(spark, sf):
    return eda.product_code_rows(with_codes(spark, sf), SPEC).select("source_id")


def product_code_samples(spark, sf):
    return eda.product_code_samples(with_codes(spark, sf), SPEC)


def class_balance(spark, sf):
    return rounded(eda.class_balance(reviews(spark, sf), SPEC))


def length_histogram(spark, sf):
    return rounded(eda.length_histogram(reviews(spark, sf), SPEC))


def label_chart(spark, sf):
    return rounded(eda.label_chart(reviews(spark, sf), SPEC))


def even_sample(spark, sf):
    return profile.even_sample(reviews(spark, sf), 37).select("source_id")


def table_metadata(spark, sf):
    return io.metadata(read(spark, sf, "documents"), "lang", NAME, REVISION, identity.sha_digest)


PLAIN = (
    validate_issue_counts, validate_issue_samples, validate_status, validate_duplicate_rows, validate_duplicate_text, processed_contract, label_rollup,
    label_distribution, label_missing, mentioned_aspects, text_availability, length_percentiles, length_fences, threshold_counts, longest_documents, pattern_signals, conversation_lengths,
    exact_raw_summary, exact_norm_summary, exact_groups, exact_members, exact_label_conflicts,
    near_signatures, near_band_matches, near_candidates, near_candidate_counts, near_jaccard, near_pairs, near_clusters, near_summary, near_pairs_native, near_clusters_native, near_summary_native,
    interim_projection, review_ids, order_keys, group_components, group_ids, group_conflicts, group_policy_flags, group_summary, preprocess_audit, interim_table,
    split_assignment, hash_split, split_summary, split_labels, split_drift, group_leakage, text_leakage, split_contract_issues, missing_split_ids, split_check,
    median_sample, mixed_sentiment_samples, product_code_rows, product_code_samples, class_balance, length_histogram, label_chart, even_sample, table_metadata,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in PLAIN}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
