"""Helpers for the training-data operators' tests."""

import pytest


@pytest.fixture
def frame(spark):
    """Builds a documents-like table with a clashing extra column."""

    def make(rows, schema="doc_id long, text string"):
        from pyspark.sql import functions as F

        return spark.createDataFrame(rows, schema).withColumn("id", F.lit("other")).withColumn("start", F.lit(7))

    return make


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables as an sf folder."""

    def write(**frames):
        for name, df in frames.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
