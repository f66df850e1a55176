"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

Quality classifier, near-duplicates, benchmark decontamination, secrets, packing. All stages but the last return the
columns of their input; each works on all that the one before it kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, packing, quality_cnn, secrets, simhash
from lectern.llm.common import WRITTEN, fresh_path, read_table, sweep
from lectern.llm.queries import quality_network

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: The intermediate tables of the stage before.
_MADE: list[str] = []


def staged(stage: Stage) -> Stage:
    """A stage that first deletes the intermediate tables of the one before, whose result has been written by then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, _MADE, docs)
        since = len(WRITTEN)
        out = stage(spark, docs, sf_dir)
        _MADE[:] = WRITTEN[since:]
        return out

    return run_stage


@staged
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; the rest go. Null texts are scored as empty ones."""
    return quality_cnn.keep_good(docs, quality_network(docs, read_table(spark, sf_dir, "labels")))


@staged
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Linked are texts whose SimHash over five-word shingles differs in at most two bits, and those whose sets of these
    shingles are at least 0.8 similar. Null and empty texts are one group; rows with a null id stay.
    """
    return simhash.keep_one_each(docs)


@staged
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


@staged
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text. Null texts stay null."""
    return secrets.redact_secrets(docs)


@staged
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of at most 2048 ids, their checksums and the ids themselves.

    ids: little-endian unsigned 16-bit integers. Null and empty texts are one piece, the end id; repeated rows stay.
    """
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.pieces(docs, tokenizer), packing.id_type(tokenizer))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: SQL cannot express these stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what each returns is written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
