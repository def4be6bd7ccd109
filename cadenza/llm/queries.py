"""The queries of the corpus operators: thin wrappers that derive the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import chat, classifier, decontamination, mixing, quality_rules, secrets, sharding, simhash, url_filters, warc
from cadenza.llm.common import table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    probe = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema))
    return chat.read_back(chat.format_chat(rows))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all documents."""
    return quality_rules.clean_documents(table(spark, sf_dir, "documents"), with_text=False, keep=["doc_id"]).drop("line_faults")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), rules).drop("url")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards and slots of all documents."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    documents = table(spark, sf_dir, "documents")
    model = classifier.train(documents, table(spark, sf_dir, "labels"))
    scored = classifier.score_documents(documents, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(classifier.remainder() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents."""
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all documents."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, in the order of positions."""
    mixed = mixing.by_position(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies", F.round("position", 9).alias("position"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, read back from normalised archives."""
    return warc.archive_pages(table(spark, sf_dir, "pages"))[0].drop("payload_ok")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_quality_rules, op3_url_filters, op4_sharding, op5_simhash, op6_quality_classifier, op7_secret_scans, op8_decontamination, op9_mixing, op10_warc)
}
