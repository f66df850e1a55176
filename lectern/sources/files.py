"""File sources: tensor manifests, safetensors headers, engine logs and evaluation caches; report and table sinks."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MANIFEST = "name string, dtype string, shape string, offset long, nbytes long"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tensor rows of a manifest: tab-separated, lines with # left out; shape as an array."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=MANIFEST)
    return rows.withColumn("shape", F.transform(F.filter(F.split(F.coalesce("shape", F.lit("")), ","), lambda s: s != ""), lambda s: s.cast("long")))


def parse_manifest_line(line: Column) -> Column:
    """struct of a manifest line's fields."""
    part = F.split(line, "\t")
    return F.struct(part[0].alias("name"), part[1].alias("dtype"), F.transform(F.filter(F.split(part[2], ","), lambda s: s != ""), lambda s: s.cast("long")).alias("shape"), part[3].cast("long").alias("offset"), part[4].cast("long").alias("nbytes"))


def lookup(names: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest's row of each name; a name that is not there is an error."""
    found = names.join(manifest.withColumn("found", F.lit(True)), "name", "left")
    return found.where(F.when(F.col("found").isNull(), F.raise_error(F.concat(F.lit("missing tensor "), F.col("name")))).otherwise(F.col("found"))).drop("found")


class SafetensorsSource(DataSource):
    """``spark.read.format("safetensors").load(path)``: a row for each tensor of a file's header, by name."""

    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return "name string, dtype string, shape array<long>, offset long, nbytes long"

    def reader(self, schema) -> DataSourceReader:
        return SafetensorsReader(self.options["path"])


class SafetensorsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.value) if "://" in partition.value else (fs.LocalFileSystem(), partition.value)
        with store.open_input_stream(path, compression=None) as f:
            (size,) = struct.unpack("<Q", f.read(8))
            header = json.loads(f.read(size))
        for name in sorted(header):
            if name != "__metadata__":
                begin, end = header[name]["data_offsets"]
                yield name, header[name]["dtype"], header[name]["shape"], 8 + size + begin, end - begin


# How the lines of an engine's log begin, the marker of its output, and a word before which a count stands.
TTFT, PREFILL, DECODE, WINDOWED = "TTFT (page 0", "prefill", "decode:", "windowed:"
OUTPUT, RULE, ADMISSIONS, DET = "===== OCR", "=====", " admissions", "<|det|>"


def _numbers(line: Column) -> Column:
    """The whole numbers of a line in order; null for no line."""
    return F.transform(F.regexp_extract_all(line, F.lit("[0-9]+"), F.lit(0)), lambda n: n.cast("long"))


def scrape_log(text: Column) -> list[Column]:
    """Bench figures from an engine's log, by the numbers' places in its lines; null where a line is missing.

    The first-token and the prefill lines end in milliseconds; the decode line counts tokens, milliseconds, tokens a
    second, steps and percent in use; the windowed line has admissions and their milliseconds behind the window.
    """
    lines = F.split(text, "\n")
    line = lambda start: F.get(F.filter(lines, lambda x: x.startswith(start)), F.lit(0))
    last = lambda n: F.get(n, F.size(n) - 1)
    decode = _numbers(line(DECODE))
    tok, ms, rate, steps, util = (F.get(decode, F.lit(k)) for k in range(5))
    body = F.substr(text, F.greatest(F.instr(text, OUTPUT), F.lit(1)))
    tags = F.when(F.instr(text, OUTPUT) > 0, (F.length(body) - F.length(F.replace(body, F.lit(DET), F.lit("")))) / len(DET)).otherwise(0)
    return [
        last(_numbers(line(TTFT))).alias("ttft_ms"), last(_numbers(line(PREFILL))).alias("prefill_ms"), tok.alias("tok"), ms.alias("decode_ms"), rate.alias("tok_s"), steps.alias("steps"), util.alias("util_pct"),
        F.round(F.try_divide(ms.cast("double"), steps.cast("double")), 6).alias("step_ms"), last(_numbers(F.substring_index(line(WINDOWED), ADMISSIONS, 1))).alias("admissions"), tags.cast("long").alias("det_els"),
    ]


def engine_output(text: Column) -> Column:
    """struct(pages, tokens, body) of a whole engine output: the two counts of its marker line, and what follows it.

    The marker stands between two rules. Without it all is null.
    """
    at = F.instr(text, OUTPUT)
    head = F.substring_index(F.substr(text, at + len(RULE)), RULE, 1)
    counts = _numbers(head)
    body = F.substr(text, at + len(RULE) + F.length(head) + len(RULE))
    return F.when(at > 0, F.struct(F.get(counts, F.lit(0)).alias("pages"), F.get(counts, F.lit(1)).alias("tokens"), body.alias("body")))


def read_engine_output(spark: SparkSession, path: str) -> DataFrame:
    """(path, pages, tokens, body) of each engine output under ``path``, one a file."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), engine_output(F.col("value")).alias("o"))
    return t.select("path", "o.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, n_pages) of the PDF files under ``path``; n_pages is null for what is none or cannot be read.

    The page count is the largest of the page trees' counts, which stand in clear in files without object streams.
    """
    found = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.decode("content", "ISO-8859-1").alias("raw"))
    counts = F.transform(F.regexp_extract_all("raw", F.lit(r"/Count\s+([0-9]+)"), F.lit(1)), lambda n: n.try_cast("int"))
    return found.select("path", "bytes", F.when(F.startswith("raw", F.lit("%PDF-")), F.array_max(counts)).alias("n_pages"))


def read_f32(spark: SparkSession, path: str) -> DataFrame:
    """(path, values) of files of little-endian 32-bit floats."""
    return spark.read.format("binaryFile").load(path).select("path", f32_values(F.col("content")).alias("values"))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def f32_values(content: pa.Array) -> pa.Array:
    """The little-endian 32-bit floats of each byte string; a rest of fewer than four bytes is an error."""
    sizes = np.array([0 if v is None else len(v) for v in content.to_pylist()], np.int64)
    if (sizes % 4).any():
        raise ValueError("not a whole number of 32-bit floats")
    flat = np.frombuffer(b"".join(v or b"" for v in content.to_pylist()), "<f4")
    ends = np.concatenate([[0], np.cumsum(sizes // 4)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float32()), mask=content.is_null())


@F.arrow_udf(T.BinaryType())
def f32_bytes(values: pa.Array) -> pa.Array:
    """Each array of floats as little-endian 32-bit floats."""
    return pa.array([None if v is None else np.asarray(v, "<f4").tobytes() for v in values.to_pylist()], pa.binary())


def read_eval_cache(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a cache file that maps ``doc/page/mode`` to a record, with the key split."""
    record = "struct<text:string,conf:double,lowf:double,risk:double,p10:double,wminp:double,emean:double,wment:double,regp:double,ntok:int>"
    t = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{record}>")).alias("key", "r"))
    k = F.split("key", "/")
    return t.select(k[0].alias("doc"), k[1].cast("int").alias("page"), k[2].alias("mode"), "r.*")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="overwrite", escape='"')


def write_json(df: DataFrame, path: str) -> None:
    """A JSON record a line."""
    df.write.json(path, mode="overwrite")


def write_report(lines: DataFrame, path: str, order: str, value: str = "line") -> None:
    """Writes text lines in order, as one file: for reports, which are short."""
    lines.orderBy(order).coalesce(1).select(value).write.text(path)
