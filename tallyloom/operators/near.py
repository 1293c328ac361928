"""Near-duplicate pairs and clusters within a source split: SimHash bands, then lexical verification.

Copies of a text are taken together first: signatures, buckets and the costly kernels see each text
once, and counts of row pairs come from multiplicities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.functions.identity import cluster_ids, duplicate_group_id, pair_id
from tallyloom.functions.similarity import blake2b_64, jaccard_of, sequence_ratio_of, signature_of
from tallyloom.operators.exact import from_spread, spread
from tallyloom.operators.graph import connected_components, cut
from tallyloom.spec import NearSpec, TableSpec


def prepared(df: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    """split, row, id, norm, chars, tokens and the labels."""
    out = df.select(F.col(spec.split).alias("split"), F.col(spec.row).alias("row"), F.col(spec.id).alias("id"), X.keyed_of(F.col(spec.text)).alias("__k"), *spec.labels.columns)
    return out.select("split", "row", "id", F.col("__k.norm").alias("norm"), *spec.labels.columns, X.char_count(F.col("__k.norm")).alias("chars"), F.col("__k.tokens").alias("tokens"))


def eligible(prep: DataFrame, near: NearSpec = NearSpec()) -> DataFrame:
    return prep.where((F.col("chars") >= near.min_chars) & (F.col("tokens") >= near.min_tokens))


def distinct_texts(prep: DataFrame, near: NearSpec = NearSpec()) -> DataFrame:
    """(split, row, last, norm, chars, n): eligible texts once each, by their first row; n rows up to row `last` have the text. A hot text is combined on the map side."""
    rows = eligible(prep, near).withColumn("__k", F.sha2("norm", 256))
    return rows.groupBy("split", "__k").agg(F.min("row").alias("row"), F.max("row").alias("last"), F.first("norm").alias("norm"), F.first("chars").alias("chars"), F.count("*").alias("n")).drop("__k")


def signatures(texts: DataFrame, digest: Callable[[str], bytes] = blake2b_64) -> DataFrame:
    """(split, row, n, sig): 8 bytes stand for a text from here on."""
    return texts.select("split", "row", "n", signature_of(F.col("norm"), digest).alias("sig"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def banded(sigs: DataFrame, near: NearSpec = NearSpec()) -> DataFrame:
    mask = (1 << near.band_bits) - 1
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("sig", near.band_bits * i).bitwiseAND(F.lit(mask)).alias("key")) for i in range(near.bands)])
    return sigs.select("split", "row", "n", "sig", F.inline(bands))


def band_matches(sigs: DataFrame, near: NearSpec = NearSpec()) -> DataFrame:
    """(split, raw_matches): pairs of rows that share a band, once per band, from bucket sizes: no pair is formed."""
    size = banded(sigs, near).groupBy("split", "band", "key").agg(F.sum("n").alias("m"))
    return size.groupBy("split").agg(F.sum(F.expr("m * (m - 1) div 2")).alias("raw_matches"))


def candidates(sigs: DataFrame, near: NearSpec = NearSpec()) -> DataFrame:
    """(split, first_row, second_row, n_1, n_2, distance): different texts, by their first rows, that share a band and lie within the distance. AQE splits hot buckets."""
    one = banded(sigs, near)
    a, b = one.alias("a"), one.alias("b")
    same = (F.col("a.split") == F.col("b.split")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.row") < F.col("b.row"))
    distance = hamming(F.col("a.sig"), F.col("b.sig"))
    pairs = a.join(b, same & (distance <= near.max_hamming)).select("a.split", F.col("a.row").alias("first_row"), F.col("b.row").alias("second_row"), F.col("a.n").alias("n_1"), F.col("b.n").alias("n_2"), distance.alias("distance"))
    return pairs.dropDuplicates(["split", "first_row", "second_row"])


def attached(pairs: DataFrame, prep: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with the named columns of either row as <name>_1 and <name>_2."""
    for side, row in ((1, "first_row"), (2, "second_row")):
        own = prep.select(F.col("split"), F.col("row").alias(row), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(own, ["split", row])
    return pairs


def jaccard(pairs: DataFrame, texts: DataFrame, near: NearSpec = NearSpec()) -> DataFrame:
    """Candidates of like lengths, with length_ratio and the Jaccard of their trigrams, at least the review limit."""
    out = attached(pairs, texts, ["norm", "chars", "last"])
    out = out.withColumn("length_ratio", F.least("chars_1", "chars_2") / F.greatest("chars_1", "chars_2")).where(F.col("length_ratio") >= near.min_length_ratio)
    out = out.repartition(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("jaccard", jaccard_of(F.col("norm_1"), F.col("norm_2")))
    return out.where(F.col("jaccard") >= near.review[0]).drop("chars_1", "chars_2")


def classified(ratio: Column, near: NearSpec = NearSpec()) -> Column:
    j = F.col("jaccard")
    return F.when((j >= near.high[0]) & (ratio >= near.high[1]), F.lit("high_confidence")).when((j >= near.review[0]) & (ratio >= near.review[1]), F.lit("needs_review"))


def other_order() -> Column:
    """Whether a text pair has rows in which the text of second_row comes first."""
    return F.col("second_row") < F.col("last_1")


def verified_texts(pairs: DataFrame, texts: DataFrame, near: NearSpec = NearSpec(), ratio: Callable[[Column, Column, int | None], Column] = sequence_ratio_of) -> DataFrame:
    """Text pairs with their sequence ratios, which run last, spread evenly, on what the cheap filters leave.

    The ratio is not symmetric: ratio_12 has the text of first_row as the earlier one; ratio_21 is for copies in the other
    order, and is ratio_12 where there are none.
    """
    found = jaccard(pairs, texts, near)
    found = found.withColumn("ratio_12", ratio(F.col("norm_1"), F.col("norm_2"), near.max_sequence_chars))
    # without rows in the other order, two empty texts are compared, which costs nothing
    of = lambda c: F.when(other_order(), F.col(c)).otherwise(F.lit(""))
    found = found.withColumn("ratio_21", ratio(of("norm_2"), of("norm_1"), near.max_sequence_chars))
    found = found.withColumn("ratio_21", F.when(other_order(), F.col("ratio_21")).otherwise(F.col("ratio_12")))
    keep = classified(F.col("ratio_12"), near).isNotNull() | classified(F.col("ratio_21"), near).isNotNull()
    return found.where(keep).withColumns({"key_1": duplicate_group_id(F.col("norm_1")), "key_2": duplicate_group_id(F.col("norm_2"))}).drop("norm_1", "norm_2")


def verify(found: DataFrame, prep: DataFrame, spec: TableSpec = TableSpec(), near: NearSpec = NearSpec()) -> DataFrame:
    """Row pairs of verified text pairs: pair_id, scores, confidence and label consistency.

    A pair of texts with m and n copies has m * n rows here, as the report lists pairs of rows; verified_texts() is the
    same without the copies.
    """
    cols = ["row", "id", *spec.labels.columns]
    rows = eligible(prep, near).withColumn("__k", F.sha2("norm", 256))
    for side in (1, 2):
        own = rows.select("split", F.col("__k").alias(f"key_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in cols])
        found = found.join(own, ["split", f"key_{side}"])
    ahead = F.col("row_1") < F.col("row_2")
    pick = lambda c, side: F.when(ahead, F.col(f"{c}_{side}")).otherwise(F.col(f"{c}_{3 - side}"))
    found = found.withColumn("sequence_ratio", F.when(ahead, F.col("ratio_12")).otherwise(F.col("ratio_21")))
    found = found.withColumn("confidence", classified(F.col("sequence_ratio"), near)).where(F.col("confidence").isNotNull())
    conflict = F.array_compact(F.array(*[F.when(F.col(f"{a}_1") != F.col(f"{a}_2"), F.lit(a)) for a in spec.labels.columns]))
    mixed = F.array_compact(F.array(*[F.when(F.col(f"{a}_1").isNull() != F.col(f"{a}_2").isNull(), F.lit(a)) for a in spec.labels.columns]))
    return found.select(pair_id(pick("key", 1), pick("key", 2)).alias("pair_id"), "split", pick("row", 1).alias("first_row"), pick("row", 2).alias("second_row"), pick("id", 1).alias("first_id"), pick("id", 2).alias("second_id"), "distance", "length_ratio", "jaccard", "sequence_ratio", "confidence", conflict.alias("conflicting"), mixed.alias("mixed_missing"))


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy((F.col("confidence") == "high_confidence").desc(), F.least("jaccard", "sequence_ratio").desc(), "first_row", "second_row")


def cluster_members(pairs: DataFrame) -> DataFrame:
    """(split, root, row) over high-confidence pairs, root being the least row of its component."""
    high = pairs.where("confidence = 'high_confidence'")
    node = lambda r: F.struct("split", F.col(r).alias("row"))
    parts = connected_components(high.select(node("first_row").alias("src"), node("second_row").alias("dst")))
    return parts.select(F.col("node.split").alias("split"), F.col("component.row").alias("root"), F.col("node.row").alias("row"))


def clusters(high: DataFrame, prep: DataFrame, spec: TableSpec, members: DataFrame) -> DataFrame:
    """One row per cluster: id, size, edges, least scores, label consistency, first row; its members are rows of `members`. high: rows as high_edges() makes them."""
    edges = high.join(members.withColumnRenamed("row", "first_row"), ["split", "first_row"]).groupBy("split", "root").agg(F.sum("edges").alias("edge_count"), F.min("jaccard").alias("min_jaccard"), F.min("sequence_ratio").alias("min_sequence_ratio"))
    rows = members.join(prep.select("split", "row", "id", *spec.labels.columns), ["split", "row"])
    ids = cluster_ids(rows.withColumn("id", F.col("id").cast("string")), ["split", "root"], "row", "id")
    cols = spec.labels.columns
    out = rows.groupBy("split", "root").agg(F.count("*").alias("member_count"), *spread(cols)).join(ids, ["split", "root"])
    conflict, mixed = from_spread(cols, F.col("member_count"))
    return out.join(edges, ["split", "root"]).select("cluster_id", "split", F.col("root").alias("first_row"), "member_count", "edge_count", "min_jaccard", "min_sequence_ratio", conflict.alias("conflicting"), mixed.alias("mixed_missing"))


def ordered_clusters(found: DataFrame) -> DataFrame:
    return found.orderBy((F.size("conflicting") > 0).desc(), F.desc("member_count"), "cluster_id")


def graded(found: DataFrame, near: NearSpec = NearSpec()) -> tuple[DataFrame, DataFrame]:
    """(even, uneven) text pairs: those of one confidence in whatever order their rows stand, with confidence and least ratio; those whose confidence depends on the order."""
    c12, c21 = classified(F.col("ratio_12"), near), classified(F.col("ratio_21"), near)
    even = found.where(c12.eqNullSafe(c21)).withColumns({"confidence": c12, "ratio": F.least("ratio_12", "ratio_21"), "edges": F.col("n_1") * F.col("n_2")})
    return even, found.where(~c12.eqNullSafe(c21))


def members_of_texts(even: DataFrame, odd: DataFrame, prep: DataFrame, near: NearSpec = NearSpec()) -> DataFrame:
    """cluster_members() from even text pairs and row pairs of the uneven ones: an edge per text pair, whatever the number of copies.

    All rows of a text that has an even high pair lie in one cluster, so such a text is one node, its first row; a row of
    another text is a node of its own.
    """
    high = even.where("confidence = 'high_confidence'")
    solid = high.select("split", F.col("key_1").alias("key"), F.col("first_row").alias("text_row")).union(high.select("split", "key_2", "second_row")).distinct()
    rows = cut(eligible(prep, near).select("split", "row", F.sha2("norm", 256).alias("key")).join(solid, ["split", "key"]).select("split", "row", "text_row"))
    edges = high.select("split", "first_row", "second_row")
    loose = odd.where("confidence = 'high_confidence'").select("split", "first_row", "second_row")
    for side in ("first_row", "second_row"):
        loose = loose.join(rows.withColumnRenamed("row", side), ["split", side], "left").withColumn(side, F.coalesce("text_row", side)).drop("text_row")
    node = lambda r: F.struct("split", F.col(r).alias("row"))
    parts = connected_components(edges.unionByName(loose).select(node("first_row").alias("src"), node("second_row").alias("dst")))
    parts = parts.select(F.col("node.split").alias("split"), F.col("component.row").alias("root"), F.col("node.row").alias("text_row"))
    # the nodes that are no text's first row are rows themselves
    alone = parts.join(rows, ["split", "text_row"], "left_anti").select("split", "root", F.col("text_row").alias("row"))
    return parts.join(rows, ["split", "text_row"]).select("split", "root", "row").union(alone)


def high_edges(even: DataFrame, odd: DataFrame) -> DataFrame:
    """(split, first_row, edges, jaccard, sequence_ratio): high-confidence row pairs, those of a text pair in one row."""
    one = odd.where("confidence = 'high_confidence'").select("split", "first_row", F.lit(1).cast("long").alias("edges"), "jaccard", "sequence_ratio")
    return even.where("confidence = 'high_confidence'").select("split", "first_row", "edges", "jaccard", F.col("ratio").alias("sequence_ratio")).union(one)


def pair_counts(even: DataFrame, odd: DataFrame, prep: DataFrame, spec: TableSpec = TableSpec(), near: NearSpec = NearSpec()) -> DataFrame:
    """(split, confidence, pairs, conflicts) of row pairs, even ones from multiplicities: a text's rows are counted by their labels, of which there are few."""
    cols = spec.labels.columns
    keys = even.select("split", F.col("key_1").alias("key")).union(even.select("split", "key_2")).distinct()
    rows = eligible(prep, near).select("split", F.sha2("norm", 256).alias("key"), *cols).join(keys, ["split", "key"], "left_semi").groupBy("split", "key", *cols).agg(F.count("*").alias("m"))
    both = even.select("split", "key_1", "key_2", "confidence")
    for side in (1, 2):
        both = both.join(rows.select("split", F.col("key").alias(f"key_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in (*cols, "m")]), ["split", f"key_{side}"])
    clash = F.coalesce(F.exists(F.array(*[F.coalesce(F.col(f"{c}_1") != F.col(f"{c}_2"), F.lit(False)) for c in cols]), lambda x: x), F.lit(False)) if cols else F.lit(False)
    counted = both.select("split", "confidence", (F.col("m_1") * F.col("m_2")).alias("k"), clash.alias("clash"))
    counted = counted.union(odd.select("split", "confidence", F.lit(1).cast("long"), F.size("conflicting") > 0))
    return counted.groupBy("split", "confidence").agg(F.sum("k").alias("pairs"), F.coalesce(F.sum(F.when(F.col("clash"), F.col("k"))), F.lit(0)).alias("conflicts"))


def analyze(df: DataFrame, spec: TableSpec = TableSpec(), near: NearSpec = NearSpec(), digest: Callable[[str], bytes] = blake2b_64, ratio: Callable[[Column, Column, int | None], Column] = sequence_ratio_of) -> dict[str, DataFrame]:
    """The whole analysis: prepared rows, distinct texts, signatures, candidates, text pairs, row pairs, members, clusters and the summary per split.

    Members, clusters and the summary come from text pairs and multiplicities; row pairs are formed only where they are asked
    for, as a plan that runs when it is read, and for text pairs whose confidence depends on which text comes first. Steps
    that later ones read several times are cut by checkpoints.
    """
    prep = cut(prepared(df, spec))
    texts = cut(distinct_texts(prep, near))
    sigs = cut(signatures(texts, digest))
    found = cut(candidates(sigs, near))
    verified = cut(verified_texts(found, texts, near, ratio))
    even, uneven = graded(verified, near)
    odd = cut(verify(uneven, prep, spec, near))
    members = cut(members_of_texts(even, odd, prep, near))
    groups = cut(clusters(high_edges(even, odd), prep, spec, members))
    return {
        "prepared": prep, "texts": texts, "signatures": sigs, "candidates": found, "verified": verified, "pairs": verify(verified, prep, spec, near), "members": members, "clusters": groups,
        "summary": summary(prep, sigs, found, pair_counts(even, odd, prep, spec, near), groups, near),
    }


def candidate_counts(sigs: DataFrame, found: DataFrame) -> DataFrame:
    """(split, candidate_pairs): pairs of rows within the distance, copies of one text included, from multiplicities."""
    across = found.select("split", (F.col("n_1") * F.col("n_2")).alias("w"))
    within = sigs.select("split", F.expr("n * (n - 1) div 2").alias("w"))
    return across.union(within).groupBy("split").agg(F.sum("w").alias("candidate_pairs"))


def summary(prep: DataFrame, sigs: DataFrame, found: DataFrame, counts: DataFrame, groups: DataFrame, near: NearSpec = NearSpec()) -> DataFrame:
    count = lambda df, name, test=None: df.groupBy("split").agg((F.count("*") if test is None else F.count_if(F.expr(test))).alias(name))
    of = lambda c: F.coalesce(F.sum(F.when(F.col("confidence") == c, F.col("pairs"))), F.lit(0))
    pairs = counts.groupBy("split").agg(F.sum("pairs").alias("verified_pairs"), of("high_confidence").alias("high_pairs"), of("needs_review").alias("review_pairs"), F.sum("conflicts").alias("conflict_pairs"))
    out = count(prep, "rows")
    for part in (
        sigs.groupBy("split").agg(F.sum("n").alias("eligible")), band_matches(sigs, near), candidate_counts(sigs, found), pairs,
        count(groups, "clusters"), count(groups, "conflict_clusters", "size(conflicting) > 0"), groups.groupBy("split").agg(F.sum("member_count").alias("clustered_rows")),
    ):
        out = out.join(part, "split", "left")
    out = out.na.fill(0)
    return out.withColumn("excluded", F.col("rows") - F.col("eligible"))
