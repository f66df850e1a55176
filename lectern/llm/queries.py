"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and the SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, language_id, packing, pii, quality_cnn, quality_rules, secrets, token_file, warc
from lectern.llm.common import held_out, read_table
from lectern.llm.simhash import near_duplicates


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents"))
    counts = [secrets.count_kind(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    text = lambda c: secrets.spans_string(F.col(c), pii.KINDS)
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    counts = [secrets.count_kind(F.col("base"), k).alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secrets.spans_string(F.col("base")), 256).alias("base_sha256"), secrets.spans_string(F.col("spans")).alias("spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(read_table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), *quality_rules.STATS, "base_failed", "kept", F.round("d2", 3).alias("distance2"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = warc.archive_directory(spark)
    manifest = warc.write_archives(read_table(spark, sf_dir, "pages"), directory)
    return warc.read_archives(manifest, directory).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = language_id.fit(docs.where(~held_out("doc_id", 4, 2)), "doc_id", "text", "lang")
    found = language_id.identify(docs, net)
    return found.select(F.col("id").alias("doc_id"), held_out("id", 4, 2).alias("held_out"), "lang_pred", "score")


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = token_file.id_directory(spark)
    manifest = token_file.write_ids(read_table(spark, sf_dir, "documents"), directory, public_tokenizers.path("byte_bpe_50k.json"))
    return token_file.read_ids(manifest, directory)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.pieces(read_table(spark, sf_dir, "documents"), tokenizer), packing.id_type(tokenizer), with_ids=False)


def quality_network(docs: DataFrame, labels: DataFrame) -> quality_cnn.Network | None:
    """The quality network, trained on labels that are not held out."""
    return quality_cnn.fit(docs, labels.where(~held_out("doc_id", 3, 1)), "doc_id", "text", "doc_id", "quality")


def op9_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = quality_cnn.score(docs, quality_network(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out("id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_simhash": op2_simhash,
        "op3_secrets": op3_secrets,
        "op4_quality_rules": op4_quality_rules,
        "op5_warc": op5_warc,
        "op6_language": op6_language,
        "op7_token_file": op7_token_file,
        "op8_packing": op8_packing,
        "op9_quality_cnn": op9_quality_cnn,
        "op10_decontaminate": op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the archives' records; the other operators are beyond it and are tested against brute force."""
    return {
        "op5_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
            q AS (SELECT *, coalesce(strlen(payload) >= 100 AND page_id > first, false) AS again FROM p)
            SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM q""",
    }
