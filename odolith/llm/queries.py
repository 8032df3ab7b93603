"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odolith.llm import decontam, embed_dedup, langid, language_model, licences, packing, pii, secret_scan, simhash, sql, token_alignment, token_store, url_rules, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(found.fp).alias("fingerprint"), "component_id")


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_versions(table(spark, sf_dir, "documents")))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_model.score(docs, ~language_model.held_out(docs.doc_id))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(found.vec_id == found.component_id, F.lit(False)).alias("kept"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out(docs.doc_id)))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out(found.doc_id).alias("held_out"), "lang_pred", "score", "rejected")


#: Verdicts by host and path that come before the method's own patterns.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_rules.judge(table(spark, sf_dir, "pages"), url_rules.host_rules(spark, URL_RULES))
    listed = F.col("tier") == 0
    return found.select("page_id", "host", "path", F.when(listed, F.col("rule")).alias("rule"), "verdict", F.when(~listed, F.col("rule")).alias("pattern"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_decontaminate": op2_decontaminate,
    "op3_licences": op3_licences,
    "op4_secrets": op4_secrets,
    "op5_simhash": op5_simhash,
    "op6_language_model": op6_language_model,
    "op7_best_fit": op7_best_fit,
    "op8_embeddings": op8_embeddings,
    "op9_pii": op9_pii,
    "op10_language": op10_language,
    "op11_url_rules": op11_url_rules,
    "op12_token_alignment": op12_token_alignment,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {"op2_decontaminate": sql.OP2, "op3_licences": sql.op3(), "op4_secrets": sql.OP4, "op8_embeddings": sql.OP8, "op11_url_rules": sql.OP11}
