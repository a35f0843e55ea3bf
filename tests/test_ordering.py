"""Places and next rows over ranges against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import chunking, retrieval
from skein.operators.ordering import fresh, in_order


@pytest.mark.parametrize(("n", "tasks"), [(3000, 9), (7, 5), (1, 3), (0, 2)])
def test_places_and_next_rows(spark, n, tasks):
    r = random.Random(n)
    rows = [(r.choice([None, "a", "", *["hot"] * 5]), r.randrange(40), i) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(3)
    got = in_order(df, ["g"], [F.col("v").desc(), "id"], nexts={"next id": "id", "next_v": "v"}, tasks=tasks)
    want = []
    for g in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))
        after = [*own[1:], (None, None, None)]
        want += [(*x, i, y[2], y[1]) for i, (x, y) in enumerate(zip(own, after, strict=True), 1)]
    assert sorted(map(tuple, got.collect()), key=lambda x: x[2]) == sorted(want, key=lambda x: x[2])
    whole = in_order(df, [], ["v", "id"], nexts={"then": "id"}, tasks=tasks).orderBy("rank").collect()
    assert [x.id for x in whole] == [x[2] for x in sorted(rows, key=lambda x: (x[1], x[2]))]
    assert [x["rank"] for x in whole] == list(range(1, n + 1)) and [x.then for x in whole] == [x.id for x in whole[1:]] + [None] * bool(n)


def test_odd_names_repeated_rows_and_long_values(spark):
    rows = [(1, "x" * 300_000, 2.0)] * 6 + [(None, None, float("nan"))] * 3
    df = spark.createDataFrame(rows, "part int, pos string, `a.b` double")
    got = in_order(df, ["part"], ["pos"], nexts={"last": "a.b"}, tasks=4)
    assert got.columns == ["part", "pos", "a.b", "rank", "last"]
    assert sorted((r.part or 0, r["rank"]) for r in got.collect()) == [(0, 1), (0, 2), (0, 3), *[(1, i) for i in range(1, 7)]]
    assert fresh(["A", "b_"], "a", "b", "b") == ["a_", "b", "b__"]


def test_next_passages_are_sorted_by_many_tasks(spark):
    texts = spark.range(500).selectExpr("concat('p', id) passage_id", "concat((id * 7) % 500, ':', 'text') text")
    got = chunking.adjacency(texts)
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    order = sorted(range(500), key=lambda i: (i * 7) % 500)
    assert {(r.src, r.dst) for r in got.collect()} == {(f"p{a}", f"p{b}") for a, b in zip(order, order[1:], strict=False)}
    assert chunking.adjacency(texts.limit(0)).count() == 0


def test_full_ranking_has_no_window(spark):
    rows = spark.range(400).selectExpr("id % 2 query_id", "id passage_id", "(id * 13) % 100 / 100D score")
    got = retrieval.ranked(rows, None, "score", "passage_id")
    assert "Window" not in got._jdf.queryExecution().toString()
    for q in (0, 1):
        own = sorted((i for i in range(400) if i % 2 == q), key=lambda i: (-((i * 13) % 100), i))
        assert [r.passage_id for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == own
