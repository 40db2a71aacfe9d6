"""File sources and sinks: CSV text tables, snapshot tables, serving documents."""
from __future__ import annotations

import re
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlake.operators.catalog import align_schema

POINTER = "CURRENT"
DOCUMENT_KEY = "latest"


def read_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, multiline: bool = True
) -> DataFrame:
    """CSV with header; every cell stays text, empty cells are empty texts.

    With ``multiline`` cells may hold line ends, and a file is read by one task; without
    it large files are split.
    Reads the header line first; a byte-order mark before the first name is
    dropped. With ``columns`` the result has exactly these columns.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
        .csv(path)
    )
    clean = raw.toDF(*[re.sub("^﻿", "", c) for c in raw.columns])
    filled = clean.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in clean.columns])
    return align_schema(filled, columns) if columns else filled


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def _path(spark: SparkSession, text: str):
    return spark._jvm.org.apache.hadoop.fs.Path(text)


def _filesystem(spark: SparkSession, text: str):
    return _path(spark, text).getFileSystem(spark._jsc.hadoopConfiguration())


# Versions that no kept pointer names are removed once they are this old, in seconds, so
# that readers that began before a replacement can finish.
GRACE = 3600.0
KEPT_POINTERS = 2


def replace_snapshot(df: DataFrame, table: str, partition_by: Sequence[str] = (), grace: float = GRACE) -> str:
    """Write a new version of a table and then point to it.

    Readers see the old or the new version, never a mixture or nothing, and a job may
    read the table it replaces. Each version has a numbered pointer file of its own,
    renamed into place whole; readers take the highest number. The previous version
    stays; older ones go after ``grace`` seconds.
    """
    spark = df.sparkSession
    version = new_version()
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{table}/{version}")
    publish(spark, table, version)
    remove_old_versions(spark, table, grace)
    return version


def new_version() -> str:
    return f"v-{uuid.uuid4().hex}"


def publish(spark: SparkSession, table: str, text: str, after: int | None = None) -> int:
    """Make ``text`` the newest pointer of a table.

    With ``after`` nobody else may have published since that pointer was read.
    """
    fs = _filesystem(spark, table)
    staged = _path(spark, f"{table}/_{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    number = max(pointers(spark, table), default=0) + 1
    if after is not None and number != after + 1:
        fs.delete(staged, False)
        raise RuntimeError(f"{table} was changed by another writer")
    while not fs.rename(staged, _path(spark, _pointer(table, number))):
        if after is not None or not fs.exists(_path(spark, _pointer(table, number))):
            raise OSError(f"cannot publish a version of {table}")
        number += 1  # another writer took the number
    for old in pointers(spark, table):
        if old <= number - KEPT_POINTERS:
            fs.delete(_path(spark, _pointer(table, old)), False)
    return number


def _pointer(table: str, number: int) -> str:
    return f"{table}/{POINTER}-{number:012d}"


def pointers(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the published versions that still have a pointer."""
    fs = _filesystem(spark, table)
    found = fs.globStatus(_path(spark, f"{table}/{POINTER}-*")) or []
    return sorted(int(f.getPath().getName().rsplit("-", 1)[1]) for f in found)


def pointer_text(spark: SparkSession, table: str, number: int) -> str:
    stream = _filesystem(spark, table).open(_path(spark, _pointer(table, number)))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def glob_names(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the files or folders that fit a pattern."""
    found = _filesystem(spark, pattern).globStatus(_path(spark, pattern)) or []
    return [f.getPath().getName() for f in found]


def current_version(spark: SparkSession, table: str) -> str | None:
    published = pointers(spark, table)
    return pointer_text(spark, table, published[-1]).strip() if published else None


def remove_old_versions(spark: SparkSession, table: str, grace: float = GRACE) -> int:
    """Remove the versions that no pointer names and whose write ended over ``grace`` seconds ago.

    A version that is still being written has no success mark and stays.
    """
    fs = _filesystem(spark, table)
    named = "\n".join(pointer_text(spark, table, n) for n in pointers(spark, table))
    removed = 0
    for found in fs.globStatus(_path(spark, f"{table}/v-*/_SUCCESS")) or []:
        folder = found.getPath().getParent()
        if folder.getName() not in named and time.time() - found.getModificationTime() / 1000.0 >= grace:
            fs.delete(folder, True)
            removed += 1
    return removed


def read_snapshot(spark: SparkSession, table: str, schema: T.StructType | None = None) -> DataFrame:
    """Current version of a snapshot table; empty with ``schema`` when there is none."""
    version = current_version(spark, table)
    if version is None:
        if schema is None:
            raise FileNotFoundError(f"no version of {table}")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{table}/{version}")


def read_jdbc_partitioned(
    spark: SparkSession, url: str, table: str, column: str, lower, upper, partitions: int, properties: Mapping[str, str]
) -> DataFrame:
    """Range-partitioned scan of a database table."""
    return spark.read.jdbc(url, table, column, lower, upper, partitions, properties=dict(properties))


def write_jdbc_replace(df: DataFrame, url: str, table: str, properties: Mapping[str, str], batch: int = 500) -> None:
    """Replace the rows of a database table, keeping its definition."""
    writer = df.write.mode("overwrite").option("truncate", "true").option("batchsize", batch)
    writer.jdbc(url, table, properties=dict(properties))


def document_rows(documents: DataFrame, key: str = DOCUMENT_KEY) -> DataFrame:
    """Serving rows (key, part, payload_json) of a one-row-per-part document frame."""
    return documents.select(F.lit(key).alias("key"), "part", F.to_json(F.col("document")).alias("payload_json"))


def read_document(rows: DataFrame, schema: T.DataType, key: str = DOCUMENT_KEY) -> DataFrame:
    """Parsed parts of a serving document; unreadable or empty ones give null."""
    text = F.nullif(F.trim("payload_json"), F.lit(""))
    return rows.where(F.col("key") == key).select("key", "part", F.from_json(text, schema).alias("document"))
