"""Ids that share vectors: searches, expansion and fusion by places give what tables of all ids give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.config import Config
from skein.operators import graph, retrieval
from skein.operators.similarity import Shared, nearest, top_k


def tables(spark, n: int = 400, m: int = 30):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(m, 6))
    v[7] = v[3]  # other vectors of equal score
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    e = spark.createDataFrame([(i, x.tolist() if i != 5 else None) for i, x in enumerate(v)], "place long, embedding array<double>")
    ids = spark.createDataFrame([(int(i),) for i in rng.permutation(n)], "id long")
    return ids, e, rng


@pytest.mark.parametrize("k", [1, 3, 40, None])
def test_shared_search_is_that_of_all_ids(spark, k):
    ids, e, _ = tables(spark)
    queries = e.where("place % 3 = 0 and place < 10").select(F.col("place").alias("query_id"), "embedding")
    whole = ids.join(e, ids.id % 30 == e.place).select("id", "embedding")
    rows = lambda df: sorted((r.query_id, r.id, round(r.score, 9)) for r in df.collect())
    got = nearest(Shared("id", ids, e, lambda c: c % 30), queries, k, "id")
    assert rows(got) == rows(top_k(whole, queries, k, "id"))
    if k is not None:
        assert got.count() == k * queries.count()


def test_best_of_batches_keeps_ties(spark, monkeypatch):
    monkeypatch.setattr("skein.operators.similarity.ROWS_AT_ONCE", 2)
    rows = spark.createDataFrame([(9, [0.5]), (8, [0.5 + 1e-11]), (7, [0.5]), (6, [0.5 - 1e-11]), (5, [0.1]), (4, [0.5]), (3, [0.5])], "id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(0, [1.0])], "query_id long, embedding array<double>")
    assert [sorted(r.id for r in top_k(rows, q, k).collect()) for k in (1, 2, 3)] == [[3], [3, 4], [3, 4, 6]]


def test_expansion_and_fusion_by_places(spark):
    ids, e, rng = tables(spark)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (3000, 2))]
    inc = spark.createDataFrame(pairs + pairs[:500], "entity_id long, su_id long")
    shared = lambda key, every=True: Shared(key, ids.withColumnRenamed("id", key), e, lambda c: c % 30, every)
    whole = lambda key: ids.join(e, ids.id % 30 == e.place).select(F.col("id").alias(key), "embedding")
    q = e.where("place % 4 = 0").select(F.col("place").alias("query_id"), "embedding")
    seeds = q.select("query_id", F.lit(0).alias("ord"), F.col("query_id").alias("entity_id"), F.lit(0.9).alias("score"))
    c = Config(conductance_floor=0.05, hop_top_k=4)
    a, b = (retrieval.expand(i, u("su_id"), q, seeds, u("entity_id"), c) for i, u in ((inc, shared), (inc.distinct(), whole)))
    rows = lambda df: sorted((r.query_id, r.entity_id, r.hop, round(r.score, 9)) for r in df.collect())
    assert rows(a) == rows(b) and len(rows(a)) > 60
    weights = graph.passage_weights(spark.createDataFrame([(int(p), int(x)) for p, x in rng.integers(0, 450, (2000, 2))], "passage_id long, entity_id long"))
    asked = []

    def some(wanted):
        asked.append(wanted.count())
        own = weights.join(wanted, "entity_id", "left_semi")
        return own, graph.idf(own, 400)

    one = retrieval.fuse(b, some, None, shared("passage_id", False), q, 0.7, 5)
    all_ = retrieval.fuse(b, weights, graph.idf(weights, 400), whole("passage_id"), q, 0.7, 5)
    rows = lambda df: sorted((r.query_id, r["rank"], r.passage_id, round(r.score, 9)) for r in df.collect())
    assert rows(one) == rows(all_) and len(rows(one)) == 5 * q.count() and asked == [b.select("entity_id").distinct().count()]


def test_units_vectors_stay_where_they_are(spark):
    """No plan of the relational queries joins vectors to a whole table of keys."""
    from skein import queries as registry

    g = registry._relational(lambda name: registry.table(spark, "/root/testdata/sf0.001", name))
    assert all(isinstance(g[x], Shared) and g[x].ids.columns == [g[x].key] for x in ("units", "entities", "passages"))
    assert "Aggregate" not in g["inc"]._jdf.queryExecution().optimizedPlan().toString()


def test_batches_and_scans_are_bounded(spark, tmp_path):
    """Long texts add up neither in the batches that go to Python nor in what a scan decodes at once."""
    import pyarrow as pa

    from skein.llm._shared import bounded_batches

    bounded_batches(spark)
    spark.range(0, 1500, 1, 1).selectExpr("repeat('x', 4000) text").write.parquet(str(tmp_path / "t"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    got = [r.n for r in spark.read.parquet(str(tmp_path / "t")).mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 6_000_000 and max(got) < 2 << 20
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 1024 and int(spark.conf.get("parquet.block.size")) <= 16 << 20
