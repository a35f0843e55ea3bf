"""The hypergraph as edge tables: incidence, degrees, passage weights and inverse document frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.core import join_checked, written
from skein.functions import scope


def incidence(edges: DataFrame, entity: str = "entity_id", unit: str = "su_id") -> DataFrame:
    """Distinct (entity_id, su_id)."""
    return edges.select(F.col(entity).alias("entity_id"), F.col(unit).alias("su_id")).where("entity_id is not null and su_id is not null").distinct()


def degrees(inc: DataFrame, by: str) -> DataFrame:
    return inc.groupBy(by).agg(F.count(F.lit(1)).alias("degree"))


def graph_stats(inc: DataFrame) -> DataFrame:
    """One row: vertices, hyperedges, incidences, sparsity, least and largest degrees of both; zeros for an empty graph."""
    v = degrees(inc, "entity_id").agg(F.count(F.lit(1)).alias("n_vertices"), F.min("degree").alias("min_vertex_degree"), F.max("degree").alias("max_vertex_degree"), F.sum("degree").alias("nnz"))
    e = degrees(inc, "su_id").agg(F.count(F.lit(1)).alias("n_hyperedges"), F.min("degree").alias("min_hyperedge_degree"), F.max("degree").alias("max_hyperedge_degree"))
    both = v.crossJoin(F.broadcast(e))  # one row each
    cells = F.col("n_vertices") * F.col("n_hyperedges")
    return both.withColumn("sparsity", F.when(cells > 0, 1 - F.col("nnz") / cells).otherwise(0.0)).na.fill(0)


def passage_weights(mentions: DataFrame, passage: str = "passage_id", entity: str = "entity_id") -> DataFrame:
    """(passage_id, entity_id, cnt, weight): mentions of an entity in a passage, and their share of the passage's mentions."""
    counts = mentions.groupBy(F.col(passage).alias("passage_id"), F.col(entity).alias("entity_id")).agg(F.count(F.lit(1)).alias("cnt"))
    total = counts.groupBy(F.col("passage_id").alias("__p")).agg(F.sum("cnt").alias("total"))
    share = F.when(F.col("total") > 0, F.col("cnt") / F.col("total")).otherwise(0.0)
    return counts.join(total, F.col("passage_id") == F.col("__p")).select("passage_id", "entity_id", F.col("cnt").cast("double").alias("cnt"), share.alias("weight"))


def counted_weights(incident: DataFrame, counts: DataFrame) -> DataFrame:
    """(passage_id, entity_id, cnt, weight) of incident pairs (passage_id, entity_id, text, name) by counts (passage_id, entity_id, cnt).

    A pair without a count has as many as its passage's text holds the name, one after another (no text or no name: 0).
    """
    known = counts.select(F.col("passage_id").alias("__p"), F.col("entity_id").alias("__e"), "cnt")
    text, name = F.coalesce("text", F.lit("")), F.coalesce("name", F.lit(""))
    held = F.when(name == "", 0).otherwise((F.length(text) - F.length(F.replace(text, name, F.lit("")))) / F.length(name))
    both = incident.join(known, (F.col("passage_id") == F.col("__p")) & (F.col("entity_id") == F.col("__e")), "left")
    both = both.select("passage_id", "entity_id", F.coalesce("cnt", held).cast("double").alias("cnt"))
    total = both.groupBy(F.col("passage_id").alias("__p")).agg(F.sum("cnt").alias("total"))
    share = F.when(F.col("total") > 0, F.col("cnt") / F.col("total")).otherwise(0.0)
    return both.join(total, F.col("passage_id") == F.col("__p")).select("passage_id", "entity_id", "cnt", share.alias("weight"))


def idf_within(weights: DataFrame, passages: DataFrame) -> DataFrame:
    """idf of many corpora, each by its own number of passages; ids are keys as in functions.scope."""
    n = passages.groupBy(scope.prefix(F.col("passage_id")).alias("corpus")).agg(F.count(F.lit(1)).alias("n"))
    df = weights.groupBy("entity_id").agg(F.countDistinct("passage_id").alias("df")).withColumn("own", scope.prefix(F.col("entity_id")))
    both = join_checked(df, written(n, "corpora"), F.col("own") == F.col("corpus"))
    return both.select("entity_id", "df", F.log(F.col("n").cast("double") / F.greatest("df", F.lit(1))).alias("idf"))


#: Pairs that a task makes distinct, about, so that its memory doesn't grow with the table.
PAIRS_AT_ONCE = 500_000


def idf(weights: DataFrame, n_passages: int, n_pairs: int | None = None) -> DataFrame:
    """(entity_id, df, idf): ln(N / max(df, 1)) over the passages that hold an entity. Rows of a pair may be several.

    n_pairs: about how many rows there are, if that is known; then tasks are as many as they need, else as a shuffle has.
    """
    pairs = weights.select("entity_id", "passage_id")
    if n_pairs is not None:
        pairs = pairs.repartition(max(2 * weights.sparkSession.sparkContext.defaultParallelism, -(-n_pairs // PAIRS_AT_ONCE)), "entity_id", "passage_id")
    df = pairs.distinct().groupBy("entity_id").agg(F.count("passage_id").alias("df"))
    return df.withColumn("idf", F.log(F.lit(float(n_passages)) / F.greatest("df", F.lit(1))))
