"""Many corpora in one index: the rows are those of an index for each."""

import numpy as np
from pyspark.sql import functions as F

from skein.config import Config
from skein.core import shared_path
from skein.corpora import Corpora
from skein.engine import Engine
from skein.functions import providers, scope
from skein.operators import entities, graph, mentions
from skein.operators.similarity import top_k

CONFIG = Config(top_k=3, conductance_floor=0.01, unit_min_words=4, max_hops=2)
BAY = [
    "The harbour of Lantern Bay was built by Morwenna Pascoe. Morwenna Pascoe drew every quay of the harbour herself.",
    "Morwenna Pascoe kept bees near the harbour. Her bees made heather honey for the lighthouse keeper.",
    "The lighthouse keeper of Lantern Bay wrote letters. Every letter praised the heather honey and the quay.",
]
TOWN = [
    "The harbour of Granite Town was closed by winter storms. A lighthouse keeper watched the harbour in winter.",
    "Granite Town sells heather honey at its winter market. The market stands beside the harbour.",
]
#: The last passage of the bay is also one of the town, so that a shared text has an id in each.
TEXTS = {"Bay /%\x1f": BAY, "town": [*TOWN, BAY[2]]}
QUESTIONS = [("q1", "Who built the harbour of Lantern Bay?"), ("q2", "Where is heather honey sold in winter?"), ("q3", "Nothing known?")]


def _docs(spark, texts=None):
    return spark.createDataFrame([(c, t) for c, ts in (texts or TEXTS).items() for t in ts], "corpus_name string, text string")


def _own(spark, extractor=None):
    out = {}
    for name, texts in TEXTS.items():
        out[name] = Engine(spark, shared_path(spark, "one"), CONFIG, **({"extractor": extractor} if extractor else {}))
        out[name].index(spark.createDataFrame([(t,) for t in texts], "text string"))
    return out


def _plain(df, keys, corpus):
    """The rows of one corpus with plain ids."""
    df = df.where(scope.corpus_of(F.col(keys[0])) == corpus)
    return df.withColumns({k: scope.bare(F.col(k)) for k in keys})


def _rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.collect()), key=str)


KEYS = {
    "passages": ["id"], "units": ["id"], "passage_units": ["passage_id", "su_id"], "mentions": ["passage_id", "su_id"], "entities": ["entity_id", "cluster"], "support": ["passage_id", "su_id", "entity_id", "cluster"],
    "incidence": ["entity_id", "su_id"], "passage_entity": ["passage_id", "entity_id"], "idf": ["entity_id"], "passage_adjacency": ["src", "dst"],
}


def _same(many, own):
    for name, e in own.items():
        for table, keys in KEYS.items():
            expected = e.table(table)
            expected = expected.drop("schema_version")
            assert _rows(_plain(many.table(table), keys, name).select(*expected.columns)) == _rows(expected), (name, table)


def test_many_corpora_are_as_an_index_each(spark):
    many, own = Corpora(spark, shared_path(spark, "many"), CONFIG), _own(spark)
    many.index(_docs(spark))
    _same(many, own)
    assert many.table("entities").count() > 8
    asked = spark.createDataFrame([(f"{c}-{q}", text, c) for c in [*TEXTS, "unknown"] for q, text in QUESTIONS], "query_id string, question string, corpus_name string")
    got = many.retrieve(asked)
    seeds = many.seeds(asked)
    for name, e in own.items():
        mine = asked.where(F.col("corpus_name") == name).drop("corpus_name")
        expected = _rows(e.retrieve(mine))
        assert expected and _rows(_plain(got.select("passage_id", "query_id", "rank", "score"), ["passage_id"], name).select("query_id", "rank", "passage_id", "score")) == expected
        assert _rows(_plain(seeds.drop("ord"), ["entity_id"], name)) == _rows(e.seeds(mine).drop("ord"))
    assert not any(r.query_id.startswith("unknown") for r in got.collect())


def test_new_passages_touch_their_corpus_alone(spark):
    asked = []

    def extract(text):
        asked.append(text)
        return [(w, "name", w) for w in text.replace(".", "").split() if w[0].isupper()]

    extractor = providers.extraction_provider(extract)
    many = Corpora(spark, shared_path(spark, "grown"), CONFIG, extractor)
    many.index(_docs(spark, {"Bay /%\x1f": BAY[:2], "town": TEXTS["town"]}))
    before = many.snapshot().version
    many.index(_docs(spark, {"Bay /%\x1f": BAY}))
    _same(many, _own(spark, extractor))
    assert many.index(_docs(spark, {"town": TOWN[:1]})).version == before + 1 == many.snapshot().version  # nothing new
    assert Corpora(spark, many.folder, CONFIG, version=before).table("passages").count() == 5


def test_empty_and_null(spark):
    many = Corpora(spark, shared_path(spark, "none"), CONFIG)
    docs = spark.createDataFrame([(None, BAY[0]), ("", BAY[1]), ("x", None), ("x", "")], "corpus_name string, text string")
    many.index(docs.limit(0))
    assert many.table("entities").count() == 0
    many.index(docs)
    assert sorted(scope_name for (scope_name,) in many.table("passages").select(scope.corpus_of(F.col("id"))).collect()) == ["", "", "x"]
    got = many.retrieve(spark.createDataFrame([("q", None, None), ("r", "", "x")], "query_id string, question string, corpus_name string"))
    assert {r.query_id for r in got.collect()} == {"q", "r"}


def test_top_k_within(spark, monkeypatch):
    from skein.operators import similarity

    monkeypatch.setattr(similarity, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(similarity, "ROWS_AT_ONCE", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.normal(size=4).round(1).tolist() if i % 9 else None) for i in range(150)]
    queries = [(i, rng.choice(["a", "b", "d", None]), rng.normal(size=4).round(1).tolist()) for i in range(40)]
    v, q = spark.createDataFrame(rows, "id int, c string, embedding array<double>").repartition(3), spark.createDataFrame(queries, "query_id int, c string, embedding array<double>")
    expected = {}
    for i, c, x in queries:
        near = sorted((-round(float(np.dot(x, y)), 9), j) for j, d, y in rows if y is not None and c is not None and c == d)
        expected |= {(i, n): j for n, (_, j) in enumerate(near[:4], 1)}
    assert {(r.query_id, r["rank"]): r.id for r in top_k(v, q, 4, within="c").collect()} == expected
    monkeypatch.setattr(similarity, "QUERY_BYTES", 8 * 4 * 10)  # several turns
    assert {(r.query_id, r["rank"]): r.id for r in top_k(v, q, 4, within="c").collect()} == expected
    assert top_k(v, q, None, within="c").count() == sum(1 for _, c, _ in queries for _, d, y in rows if y is not None and c is not None and c == d)


def test_names_of_keys(spark):
    keys = np.array(["many words here\x1farthur", "many words here\x1fking arthur", "many words here\x1fquay"], object)
    bare = np.array([k.partition("\x1f")[2] for k in keys], object)
    a, b = [0, 0, 1], [1, 2, 2]
    assert (entities.names_may_agree(0.72, True)(keys[a], keys[b]) == entities.names_may_agree(0.72)(bare[a], bare[b])).all()


def test_known_names_within(spark):
    nodes = spark.createDataFrame([("a", ["lantern bay"], "t"), ("b", ["bay"], "t")], "c string, aliases array<string>, entity_type string")
    q = spark.createDataFrame([(1, "a", "Lantern Bay?"), (2, "b", "Lantern Bay?"), (3, "z", "bay")], "query_id int, c string, question string")
    assert {(r.query_id, r.surface_text) for r in mentions.known_names(q, nodes, "c").collect()} == {(1, "lantern bay"), (2, "bay")}


def test_missing_counts_come_from_the_text(spark):
    incident = [("p", "e", "honey and honey", "honey"), ("p", "f", "honey and honey", "and"), ("p", "g", "honey and honey", ""), ("q", "e", None, "honey"), ("r", "e", "aaa", "aa"), ("r", "f", "aaa", None)]
    rows = spark.createDataFrame(incident, "passage_id string, entity_id string, text string, name string")
    counts = spark.createDataFrame([("p", "f", 6), ("z", "e", 5)], "passage_id string, entity_id string, cnt int")
    got = {(r.passage_id, r.entity_id): (r.cnt, r.weight) for r in graph.counted_weights(rows, counts).collect()}
    assert got == {("p", "e"): (2.0, 0.25), ("p", "f"): (6.0, 0.75), ("p", "g"): (0.0, 0.0), ("q", "e"): (0.0, 0.0), ("r", "e"): (1.0, 1.0), ("r", "f"): (0.0, 0.0)}
