"""A training corpus from raw documents in five stages, each of which applies one operator and acts on its decisions."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odolith.llm import decontam, langid, packing, pii, simhash
from odolith.session import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject.

    Texts that are null or have no letter are rejected; a null id or language and repeated rows stay as they are; an empty
    table gives an empty one.
    """
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs.filter(~langid.held_out(docs.doc_id)))
    return langid.predict(docs, model, keep=COLUMNS).filter(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, null last.

    Rows are judged by their text: rows that share an id are in groups of their own, and repeated rows are copies. All
    texts without words are one group; an empty table gives an empty one.
    """
    return simhash.one_of_each(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text shares no window with a benchmark item.

    Each row is judged by its own text, so clean rows stay whatever ids they share or lack; texts without words are clean;
    an empty benchmark or table drops nothing.
    """
    # what a text holds decides, so its digest names it
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    docs = docs.select(*COLUMNS)
    found = decontam.find_contamination(docs.select("text", digest.alias("digest")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("digest",))
    hit = found.filter("n_hit > 0").select("digest").distinct()
    return docs.join(hit, digest == hit.digest, "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their personal data masked; n_chars follows the text.

    A null text and its n_chars stay null; repeated rows and rows without an id are each masked; an empty table gives an
    empty one.
    """
    # the model needs all candidates before any is decided on: they are found once
    annotated = cut(pii.annotate(docs.select(*COLUMNS)), "annotated")
    masked = pii.decide(annotated, pii.fit(annotated)).withColumn("text", pii.masked(F.col("text"), F.col("spans")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: every piece of every document and its place; a null text is an empty one, an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("pack", pack)]

#: Fingerprints, the fitted models and tokenisation have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
