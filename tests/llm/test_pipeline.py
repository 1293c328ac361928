import collections

import corpus_pipeline
import __spark_entry__ as entry
from tallyloom.llm import langid, linededup, mixing, nearcopies, packing
from tallyloom.llm.queries import tokenizer_path
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == columns
        if name == "language_id":
            model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
            texts = [r.text for r in docs.collect()]
            assert out.count() == sum(not x for x in langid.predict_texts(model, texts)[2])
        if name == "line_dedup":
            want = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
            before = {r.doc_id: r.text for r in docs.collect()}
            assert {r.doc_id: r.text for r in out.collect()} == {d: x for d, x in want.items() if x or x == before[d]}
            assert all(r.n_chars == len(r.text) for r in out.collect())
        if name == "near_dedup":
            classes = {r.class_id for r in nearcopies.near_copies(docs, radius=corpus_pipeline.TORN_RADIUS).collect()}
            assert {r.doc_id for r in out.collect()} == classes
        if name == "mix_sources":
            want = {r.doc_id: r.taken // r.size for r in mixing.mix_sources(docs).collect() if r.taken}
            assert collections.Counter(r.doc_id for r in out.collect()) == want
        if name == "packing":
            encode = packing.encoder(tokenizer_path())
            assert sum(r.length for r in out.collect()) == sum(len(encode(r.text)) + 1 for r in docs.collect())
            assert all(len(r.ids) == r.length for r in out.collect())
        docs = out
        seen.append(name)
    assert seen == ["language_id", "line_dedup", "near_dedup", "mix_sources", "packing"]
    assert entry.queries()["pipeline"].__wrapped__ is corpus_pipeline.run


def test_stages_on_awkward_tables(spark):
    """Null ids and texts, repeated rows, clashing columns and an empty table pass every stage; columns stay as they are but for the last."""
    text = "Retion of the inedti onar there and the whole of it, as prose goes on for a while in this place. " * 3
    rows = [(None, text, "en", "a", len(text), 1), (None, None, None, None, None, 2), (1, text, "en", "a", len(text), 3), (1, text, "en", "a", len(text), 3), (2, "", "en", None, 0, 4), (3, text.upper(), "en", "b", len(text), 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DIR)
            assert name == "packing" or out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() == 0 or docs.where("doc_id IS NULL OR doc_id IN (1, 3)").count() == docs.count()
