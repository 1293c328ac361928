"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next.

Every stage works on all rows that its predecessor kept. A caller may run STAGES one by one; run()
applies them to the documents table.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import langid, linededup, mixing, nearcopies, packing
from tallyloom.llm.queries import tokenizer_path
from tallyloom.operators.graph import remove, shared_folder

#: Bits in which the fingerprints of a text and of its near copy may differ (of 256) where line dedup has taken up to half of the copy: an angle of 49 degrees; unrelated texts lie at 90.
TORN_RADIUS = 70
#: No stage but the last is SQL: language models, patience diff, SimHash and tokenizers are tested against brute force.
ORACLE_SQL = None


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage):
    """The stage, with columns that it doesn't know under names that no result column has meanwhile."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        other = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        return stage(spark, docs.withColumnsRenamed(other), sf_dir).withColumnsRenamed({v: k for k, v in other.items()})

    return run


@apart
def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learnt from the labelled rows that are not held out; rejected documents go."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs, model)
    return out.where("NOT rejected").select(*docs.columns)


@apart
def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup; a document of which nothing is left goes, and n_chars follows the text."""
    out = linededup.dedup_lines(docs)
    out = out.where("n_deleted = 0 OR text <> ''")
    return out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@apart
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup; one document of each class stays. Copies whose shared lines went before are farther from each other than whole ones: see TORN_RADIUS."""
    return nearcopies.drop_near_copies(docs, radius=TORN_RADIUS).select(*docs.columns)


@apart
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that the mix uses k times has k rows."""
    return mixing.copies(mixing.mix_sources(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of up to 1024 ids: a row per piece of a document, with its ids."""
    return packing.harmonic_pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over documents; stages hand over in the session's checkpoint folder, where a stage's table goes once the next one's is whole."""
    where, last = shared_folder(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{where}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
