"""Tables whose parts are replaced one by one.

A table has parts (hash buckets of a key, or days). Every change writes the rows of the
parts it touches to a version folder of its own, and then publishes a list of the
folders that make up each part. So the cost of a change follows the parts it touches,
readers see all of a change or nothing, and a job that fails leaves the table as it
was. The list also keeps the last batch of every stream, so that a repeated batch is
told from a new one. One writer at a time.
"""
from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlake.session import materialize, scratch
from chartlake.sources import tables

PART = "part"
EMPTY = {"parts": {}, "streams": {}, "marks": {}}


class PartTable:
    """Table under ``path`` with rows of ``schema``; ``part`` gives the part of a row as text."""

    buckets: int | None = None

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, part: Column):
        self.spark, self.path, self.schema, self.part = spark, path, schema, part

    def listing(self) -> tuple[int, dict]:
        """Number and content of the newest list: folders by part, batches by stream, marks by part."""
        published = tables.pointers(self.spark, self.path)
        if not published:
            return 0, json.loads(json.dumps(EMPTY))
        return published[-1], json.loads(tables.pointer_text(self.spark, self.path, published[-1]))

    def parts(self) -> list[str]:
        return sorted(self.listing()[1]["parts"])

    def applied(self, stream: str, batch_id: int) -> bool:
        """True if this batch of a stream is already in the table."""
        return self.listing()[1]["streams"].get(stream, -1) >= batch_id

    def read(self, parts: Sequence[str] | None = None) -> DataFrame:
        """All rows, or those of the given parts: only their files are listed and read."""
        held = self.listing()[1]["parts"]
        chosen = sorted(held) if parts is None else [p for p in sorted(set(parts)) if p in held]
        paths = [f"{self.path}/{version}/{PART}={p}" for p in chosen for version in held[p]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, changes: DataFrame) -> list[str]:
        """Parts that hold a row of ``changes``: at most as many as the table has parts."""
        return sorted(changes.agg(F.collect_set(self.part).alias("p")).first()["p"])

    def append(self, rows: DataFrame, stream: str | None = None, batch_id: int | None = None) -> list[str]:
        """Add rows to their parts, leaving the files of these as they are."""
        if stream is not None and self.applied(stream, batch_id):
            return []
        return self._publish(rows, [], stream, batch_id, keep=True)

    def replace(
        self, rows: DataFrame, parts: Sequence[str], stream: str | None = None, batch_id: int | None = None,
        marks: dict[str, str] | None = None,
    ) -> list[str]:
        """Let ``rows`` be all rows of ``parts`` (and of other parts they belong to)."""
        return self._publish(rows, parts, stream, batch_id, marks=marks)

    def fold(self, shrink: Callable[[DataFrame], DataFrame] = lambda df: df, over: int = 8) -> list[str]:
        """Rewrite the parts that were appended to more than ``over`` times as one folder each."""
        many = [p for p, folders in self.listing()[1]["parts"].items() if len(folders) > over]
        if many:
            self.replace(shrink(self.read(many)), many)
        return sorted(many)

    def _publish(self, rows, parts, stream, batch_id, keep=False, marks=None) -> list[str]:
        number, held = self.listing()
        version = tables.new_version()
        # Rebalancing gives few files a part, and splits a part with very many rows.
        spread = rows.select(*self.schema.names, self.part.alias(PART)).hint("rebalance", F.col(PART))
        spread.write.mode("errorifexists").partitionBy(PART).parquet(f"{self.path}/{version}")
        found = tables.glob_names(self.spark, f"{self.path}/{version}/{PART}=*")
        written = sorted(name.split("=", 1)[1] for name in found)
        for p in {*parts, *written}:
            held["marks"].pop(p, None)
            old = held["parts"].pop(p, [])
            folders = [*(old if keep else []), *([version] if p in written else [])]
            if folders:
                held["parts"][p] = folders
        held["marks"].update(marks or {})
        if stream is not None:
            held["streams"][stream] = batch_id
        if self.buckets is not None:
            held["buckets"] = self.buckets
        tables.publish(self.spark, self.path, json.dumps(held), after=number)
        return written

    def clean(self, grace: float = tables.GRACE) -> int:
        """Remove version folders that no part refers to any more."""
        return tables.remove_old_versions(self.spark, self.path, grace)


class KeyedTable(PartTable):
    """Table with one row a key (or few), in hash buckets of the key.

    ``by`` names the columns that are hashed (all keys unless given); choose ``buckets``
    so that a bucket is a fair share of work for one task. A table that was written before
    keeps its number of buckets.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64,
        by: Sequence[str] = (),
    ):
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.buckets = self.listing()[1].get("buckets", buckets)
        number = F.pmod(F.xxhash64(*(by or self.keys)), F.lit(self.buckets))
        super().__init__(spark, path, schema, F.lpad(number.cast("string"), len(str(self.buckets - 1)), "0"))

    def merge(
        self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], stream: str | None = None,
        batch_id: int | None = None,
    ) -> list[str]:
        """Rewrite the buckets that ``changes`` touch as ``combine(old rows, changes)``."""
        if stream is not None and self.applied(stream, batch_id):
            return []
        with scratch(self.spark):
            stored = materialize(changes)
            parts = self.touched(stored)
            return self.replace(combine(self.read(parts), stored), parts, stream, batch_id)
