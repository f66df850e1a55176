"""The folder that driver and executors share for intermediate tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}

#: Whether a query's shuffle files are deleted when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; a temporary folder only on one machine, where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="lectern-")
        base = _LOCAL[app]
    path = f"{base.rstrip('/')}/lectern/{name}-{uuid.uuid4().hex}"
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


@contextmanager
def setting(spark: SparkSession, conf: dict[str, object]) -> Iterator[None]:
    """Settings that hold for what is run inside, and are put back after it."""
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Paths of the tables that this process has settled, in order.
WRITTEN: list[str] = []


def settle(df: DataFrame, name: str, conf: dict[str, object] | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back; settings of ``conf`` hold while it is written.

    This cuts the lineage (a lost executor costs only the running stage), computes what several later steps use once,
    and forgets the partitioning, so that joins shuffle both sides and adaptive execution can split skewed keys. The
    shuffle files behind the table are deleted when it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with setting(spark, {CLEANUP: "true"} | (conf or {})):
        df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, paths: list[str], *keep: DataFrame) -> None:
    """Deletes settled tables but those that the plans of ``keep`` read."""
    jvm, needed = spark.sparkContext._jvm, {f.rpartition("/")[0].removeprefix("file:").lstrip("/") for df in keep for f in df.inputFiles()}
    for p in paths:
        if p.removeprefix("file:").lstrip("/") not in needed:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            if p in WRITTEN:
                WRITTEN.remove(p)
