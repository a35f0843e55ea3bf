import numpy as np
import pytest

from skein.operators import ranking


@pytest.mark.parametrize("held", [16 << 20, 60])
def test_full_ranking_in_whole_and_in_ranges(spark, monkeypatch, held):
    monkeypatch.setattr(ranking, "HELD", held)
    monkeypatch.setattr(ranking, "PACK", 100)
    r = np.random.default_rng(1)
    v = r.integers(-2, 3, (150, 4)).astype(float)  # many ties
    rows = [(int(i), v[i].tolist()) for i in r.permutation(150)] + [(900, None)]
    table = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    asked = table.where("id % 10 = 0 or id = 900").selectExpr("id as query_id", "embedding")
    got = sorted(tuple(x) for x in ranking.full_ranking(table, asked).collect())
    want = sorted((q, i, k + 1) for q in range(0, 150, 10) for k, i in enumerate(sorted(range(150), key=lambda i, q=q: (-round(float(v[q] @ v[i]), 9), i))))
    assert got == want
    assert ranking.full_ranking(table, asked.limit(0)).count() == 0 == ranking.full_ranking(table.limit(0), asked).count()


def test_full_ranking_shuffles_no_scores(spark):
    """What is shuffled and written grows with the vectors, not with the result."""
    rows = [(i, [float(i % 7), 1.0]) for i in range(400)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>")
    out = ranking.full_ranking(table, table.selectExpr("id as query_id", "embedding"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and out.count() == 400 * 400
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and all("rank" not in line and "score" not in line for line in exchanged)
