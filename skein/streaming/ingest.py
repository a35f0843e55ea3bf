"""Continuous indexing: new documents of a stream are upserted batch by batch. An extension of the batch index.

A batch that is retried writes the same content ids, and upserts leave those that are stored, so each text is stored once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.sources.store import Store


def stream_into(stream: DataFrame, store: Store, checkpoint: str, text_col: str = "text", after: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    def batch(df: DataFrame, number: int) -> None:
        store.upsert(df, text_col)
        if after is not None:
            after(df, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, time_col: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window with a watermark; works on a batch as well."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")
