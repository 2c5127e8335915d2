"""Reading documents: directories of JSON files, JSON lines, and document-store exports."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidValueError


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, body, problem)``: a document for each file below a folder; empty files are skipped, bad
    JSON is told."""
    files = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")).where(F.trim("body") != "")
    return files.withColumn("problem", F.when(F.try_parse_json("body").isNull(), "not JSON"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(body)``: a document for each line."""
    return spark.read.text(path).select(F.col("value").alias("body")).where(F.trim("body") != "")


def samples(spark: SparkSession, path: str, most: int = 1 << 20) -> DataFrame:
    """``(label, text)`` of training files named ``text_<label>``, at most ``most`` characters of each."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "text_*").text(path)
    label = F.regexp_extract("_metadata.file_name", "^text_(.*)$", 1)
    return files.select(label.alias("label"), F.substring("value", 1, most).alias("text"))


#: Bytes of values that a Python worker gets or gives back at a time (a single longer value goes alone).
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds the bytes of the Arrow batches that Python workers get; however many rows a task has, and however long
    they are, its workers then need the same memory. The session's setting is only ever lowered."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))


@F.pandas_udf(T.BinaryType())
def inflated(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """zlib data unpacked; what a batch unpacks to is given back in pieces, since it may be far larger."""
    for part in parts:
        piece, size = [], 0
        for b in part:
            piece.append(None if b is None else zlib.decompress(b))
            size += len(piece[-1] or b"")
            if size >= BATCH_BYTES:
                yield pd.Series(piece, dtype=object)
                piece, size = [], 0
        if piece:
            yield pd.Series(piece, dtype=object)


def plain(value):
    """An extended-JSON value of a document store as plain JSON: dates as milliseconds, timestamps as
    [seconds, increment], ids as hex, binary as unpacked text; other kinds are errors."""
    if isinstance(value, list):
        return [plain(v) for v in value]
    if not isinstance(value, dict):
        return value
    kinds = {k for k in value if k.startswith("$")}
    if not kinds:
        return {k: plain(v) for k, v in value.items()}
    if "$oid" in value:
        return value["$oid"]
    for k, make in (("$numberInt", int), ("$numberLong", int), ("$numberDouble", float)):
        if k in value:
            return make(value[k])
    if "$date" in value:
        d = value["$date"]
        return int(pd.Timestamp(d).timestamp() * 1000) if isinstance(d, str) else int(plain(d))
    if "$timestamp" in value:
        return [value["$timestamp"]["t"], value["$timestamp"]["i"]]
    if "$binary" in value:
        b = value["$binary"]
        return zlib.decompress(base64.b64decode(b["base64"] if isinstance(b, dict) else b)).decode("utf-8", "replace")
    raise InvalidValueError(f"values of kind {sorted(kinds)} can't be indexed")


def extended(value):
    """A query for a document store, in extended JSON."""
    if isinstance(value, dict):
        return {k: extended(v) for k, v in value.items()}
    if isinstance(value, list):
        return [extended(v) for v in value]
    if isinstance(value, int) and not isinstance(value, bool) and not -(1 << 31) <= value < 1 << 31:
        return {"$numberLong": str(value)}
    return value


@F.pandas_udf(T.StructType([T.StructField("body", T.StringType()), T.StructField("problem", T.StringType())]))
def plain_documents(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Extended JSON texts as plain JSON, or the reason why not."""

    def one(b):
        try:
            return json.dumps(plain(json.loads(b)), ensure_ascii=False), None
        except Exception as e:  # told in the row
            return None, str(e)

    for part in parts:
        yield pd.DataFrame([one(b) for b in part], columns=["body", "problem"])


def store_export(spark: SparkSession, path: str) -> DataFrame:
    """``(body, problem)`` of a document store's JSON-lines export."""
    small_batches(spark)
    made: Column = plain_documents(F.col("body"))
    return json_lines(spark, path).select(made.alias("d")).select("d.*")


def store_table(spark: SparkSession, host: str, collection: str, port: int = 27017, query: dict | None = None) -> DataFrame:
    """Documents of a running document store, by its Spark connector if that is installed."""
    reader = spark.read.format("mongodb").option("connection.uri", f"mongodb://{host}:{port}").option("collection", collection)
    if query:
        reader = reader.option("aggregation.pipeline", json.dumps([{"$match": extended(query)}]))
    rows = reader.load()
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("body"))
