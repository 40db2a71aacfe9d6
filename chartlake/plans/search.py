"""Text search over a stored catalogue without reading all of it.

Beside the items, which are a table in hash buckets of the id, stands a table of
postings (trigram, id) in buckets of the trigram. A query reads the buckets of its own
trigrams, keeps the ids that have all of them, and tests the text of these items.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlake.operators.charts import SEARCH_COLUMNS, search_songs, search_text
from chartlake.plans.upkeep import upsert_table
from chartlake.session import materialize, scratch
from chartlake.sources.parts import KeyedTable

GRAM = 3


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters; none for shorter texts."""
    places = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    found = F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(GRAM))))
    return F.when(F.length(text) >= GRAM, found).otherwise(F.array().cast("array<string>"))


class SearchTable:
    """Items of a fixed schema with their postings, under one folder."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] = SEARCH_COLUMNS, buckets: int = 64
    ):
        self.spark, self.columns = spark, tuple(columns)
        self.items = KeyedTable(spark, f"{path}/items", schema, ["id"], buckets)
        fields = [T.StructField("gram", T.StringType()), T.StructField("id", T.StringType())]
        self.postings = KeyedTable(spark, f"{path}/postings", T.StructType(fields), ["gram", "id"], buckets, ["gram"])

    def upsert(self, updates: DataFrame) -> None:
        """Update or insert items.

        Postings are added before the items change, so that no item is ever without its
        own; those of a former text stay and only cost a test.
        """
        with scratch(self.spark):
            stored = materialize(updates)
            grams = stored.select(F.explode(trigrams(search_text(self.columns))).alias("gram"), F.col("id").cast("string"))
            self.postings.append(grams.distinct())
            upsert_table(self.items, stored)

    def search(self, query: str) -> DataFrame:
        """``search_songs`` over all items; queries of less than three characters read them all."""
        text = query.strip().lower()
        grams = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
        if not grams:
            return search_songs(self.items.read(), query, self.columns)
        wanted = self.spark.createDataFrame([(g, "") for g in grams], self.postings.schema)
        held = self.postings.read(self.postings.touched(wanted)).where(F.col("gram").isin(grams))
        every = held.groupBy("id").agg(F.count_distinct("gram").alias("_n")).where(F.col("_n") == len(grams))
        ids = materialize(every.select("id"))
        candidates = self.items.read(self.items.touched(ids)).join(ids, "id", "left_semi")
        return search_songs(candidates, query, self.columns)
