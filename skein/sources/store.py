"""Content-addressed stores: append-only Parquet tables of (id, text, embedding), and the cache of extractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import content_id


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def missing(texts: DataFrame, stored: DataFrame, prefix: str, text_col: str = "text") -> DataFrame:
    """(id, text): distinct texts whose id isn't stored."""
    new = texts.where(F.col(text_col).isNotNull()).select(content_id(prefix, F.col(text_col)).alias("id"), F.col(text_col).alias("text")).dropDuplicates(["id"])
    return new.join(stored.select("id"), "id", "left_anti")


class Store:
    """One store of texts. A write adds files; readers see whole commits."""

    schema = "id string, text string, embedding array<float>"

    def __init__(self, spark: SparkSession, path: str, prefix: str, embed: Callable[[Column], Column]):
        self.spark, self.path, self.prefix, self.embed = spark, path, prefix, embed

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if _exists(self.spark, self.path) else self.spark.createDataFrame([], self.schema)

    def upsert(self, texts: DataFrame, text_col: str = "text") -> None:
        """Embeds and appends only what isn't stored."""
        new = missing(texts, self.read(), self.prefix, text_col)
        new.select("id", "text", self.embed(F.col("text")).alias("embedding")).write.mode("append").parquet(self.path)

    def clear(self) -> None:
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(self.path)


def uncached(passages: DataFrame, cache: DataFrame, version: int, id_col: str = "passage_id") -> DataFrame:
    """Passages without an extraction of this version."""
    return passages.join(cache.where(F.col("schema_version") == version).select(id_col).distinct(), id_col, "left_anti")
