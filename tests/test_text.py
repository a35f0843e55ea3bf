"""Normalisation, filters and planner parsing against hand-checked values."""

import json

import pytest
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.entities import name_similarity
from skein.plans import planner

NAMES = [
    ("The Kynance Cove", "kynance cove", "kynance cove"), ("the the cat", "the cat", "cat"), ('"Bob\'s"', "bob's", "bob"), ("Bob's", "bob", "bob"), ("IL-6/IL-8", "il 6 / il 8", "il 6 / il 8"),
    ("drug(s)", "drug", "drug"), ("Cancer (stage II)", "cancer", "cancer"), ("x (y) z", "x z", "x z"), ("A&E", "a&e", "a&e"), ("Über-Maß!", "über maß", "über maß"), ("An  Old   Mill", "old mill", "old mill"), ("the", "the", "the"), (None, "", ""),
]


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_names(spark):
    assert column(spark, [n[0] for n in NAMES], X.normalize_name) == [n[1] for n in NAMES]
    assert column(spark, [n[0] for n in NAMES], lambda c: X.normalize_name(X.normalize_name(c))) == [n[2] for n in NAMES]


def test_types(spark):
    assert column(spark, [None, "", "  ", "Medical Condition", "a\t\tb", "x-y"], X.normalize_type) == ["entity", "entity", "entity", "medical_condition", "a_b", "x_y"]


def test_descriptions_and_answers(spark):
    assert column(spark, ["  A  Thing. ", ";:", None], X.normalize_description) == ["a thing", "", ""]
    assert column(spark, ["The cat's  a Pet!", None, "an A the"], X.normalize_answer) == ["cats pet", "", ""]
    assert column(spark, ["t Answer: x Answer: y", "none"], X.extract_answer) == ["x", "none"]
    assert column(spark, ["12:abc", " 7:x", "x:1", ""], X.index_prefix) == [12, 7, None, None]


@pytest.mark.parametrize(
    ("name", "kind", "described", "low"),
    [("", "x", "d", True), ("abc", "pronoun", "d", True), ("those", "x", "d", True), ("ab", "x", "d", True), ("a b c d e f g h i", "x", "d", True), ("a&--", "x", "d", True), ("abc", "x", "", True), ("abc", "x", "d", False), ("the", "x", "d", False)],
)
def test_low_value(spark, name, kind, described, low):
    assert spark.range(1).select(X.is_low_value(F.lit(name), F.lit(kind), F.lit(described))).first()[0] is low


@pytest.mark.parametrize(
    ("a", "b", "want"), [("king arthur", "arthur", 0.705882), ("kynance", "kynance cove", 0.736842), ("hodgkin lymphoma", "hodgkins lymphoma", 0.969697), ("north sea", "south sea", 0.777778), ("john curgenven", "curgenven john", 1.0), ("x", "x", 1.0)]
)
def test_name_similarity(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(name_similarity(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want, abs=1e-6)


def test_contains_answer(spark):
    rows = [("It is the Blue Whale.", "blue whale", 1), ("no", "yes", 0), ("", "x", 0), ("x", " ", 0), ("anything", "the", 1), (None, "x", 0)]
    got = spark.createDataFrame(rows, "p string, g string, w int").select(X.contains_answer(F.col("p"), F.col("g")).alias("c"), "w").collect()
    assert all(r.c == r.w for r in got)


def plan_of(spark, query, response, most=5):
    row = spark.createDataFrame([(query, response)], "q string, r string").select(planner.plan(F.col("q"), F.col("r"), most).alias("p")).first().p
    return row.asDict(True)


def test_plans(spark):
    good = {"is_complex": True, "reasoning": " r ", "sub_queries": [{"query": ""}, {"query": " a ", "id": ""}, {"id": "k", "query": "b", "purpose": "p", "answer_type": "date"}], "synthesis_instruction": ""}
    p = plan_of(spark, " q ", "```json\n" + json.dumps(good) + "\n```")
    assert (p["original_query"], p["is_complex"], p["reasoning"], p["synthesis_instruction"]) == ("q", True, "r", planner.SYNTHESIS)
    assert [(s["id"], s["query"], s["purpose"], s["answer_type"]) for s in p["sub_queries"]] == [("sq2", "a", planner.PURPOSE, "other"), ("k", "b", "p", "date")]
    assert len(plan_of(spark, "q", "so: " + json.dumps(good) + " end", 1)["sub_queries"]) == 1
    assert plan_of(spark, "q", "nothing")["reasoning"] == planner.NOT_JSON and plan_of(spark, "q", "[1]")["reasoning"] == planner.NOT_JSON
    assert plan_of(spark, "  ", json.dumps(good))["reasoning"] == planner.EMPTY
    bare = plan_of(spark, "q", "{}")
    assert bare["is_complex"] is False and bare["sub_queries"][0]["purpose"] == planner.DIRECT and bare["reasoning"] == planner.REASONING
