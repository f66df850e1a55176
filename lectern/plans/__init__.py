"""The catalogue: every query of the document-analytics operators, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import confidence, evaluation, jobs, kernels, layout, network, service, streams, tensor, text

MODULES = (text, confidence, jobs, service, evaluation, tensor, network, layout, kernels, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
