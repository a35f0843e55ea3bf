"""Sparse pairs against all pairs, snapshots with readers and failed writers, and entities kept up to date against a full build."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.config import Config
from skein.core import shared_path
from skein.engine import Engine
from skein.functions import providers
from skein.operators import entities, resolution, sparse
from skein.operators.components import connected_components
from skein.sources.snapshots import Conflict, Snapshots


def vectors(n, seed, hot=True):
    """Unit vectors of few coordinates out of 40, some of them alike, and one coordinate that most have."""
    rng = np.random.default_rng(seed)
    v = np.zeros((n, 40))
    for row in v:
        row[rng.choice(40, rng.integers(1, 6), replace=False)] = rng.integers(1, 4)
        row[0] += 2 * (hot and rng.random() < 0.7)
    for i in range(0, n - 1, 7):
        v[i + 1] = v[i] + (rng.random(40) < 0.05)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("cut", [0.3, 0.6, 0.9, 1.0])
def test_sparse_pairs_are_all_pairs(spark, monkeypatch, cut):
    monkeypatch.setattr(sparse, "BLOCK", 40)
    monkeypatch.setattr(sparse, "SLICE", 7)
    v = vectors(260, int(cut * 10))
    kinds = [None if i % 5 == 0 else "x" for i in range(len(v))]
    rows = spark.createDataFrame([(f"n{i:03d}", k, x.tolist()) for i, (k, x) in enumerate(zip(kinds, v, strict=True))] + [("zero", "x", [0.0] * 40), ("none", "x", None)], "id string, kind string, v array<double>")
    rows = rows.withColumn("entries", sparse.sparse_entries("v")).withColumn("fresh", F.col("id") < "n050").repartition(3)
    cos = v @ v.T
    want = {(f"n{i:03d}", f"n{j:03d}") for i in range(len(v)) for j in range(i + 1, len(v)) if kinds[i] == kinds[j] and cos[i, j] >= cut}
    near = {(f"n{i:03d}", f"n{j:03d}") for i in range(len(v)) for j in range(i + 1, len(v)) if abs(cos[i, j] - cut) < 1e-9}  # decided by the last digit
    got = [(r.a, r.b) for r in sparse.sparse_pairs(rows, cut).collect()]
    assert len(got) == len(set(got)) and set(got) - near == want - near
    some = [(r.a, r.b) for r in sparse.sparse_pairs(rows, cut, fresh="fresh").collect()]
    assert len(some) == len(set(some)) and set(some) - near == {p for p in want if p[0] < "n050"} - near
    assert all(r.cosine >= cut and abs(r.cosine - cos[int(r.a[1:]), int(r.b[1:])]) < 1e-9 for r in sparse.sparse_pairs(rows, cut).collect())


def test_sparse_pairs_of_no_unit_length(spark):
    rng = np.random.default_rng(4)
    v = vectors(120, 4) * rng.uniform(0.2, 3, (120, 1))
    rows = spark.createDataFrame([(i, "x", x.tolist()) for i, x in enumerate(v)], "id int, kind string, v array<double>").withColumn("entries", sparse.sparse_entries("v"))
    dots = v @ v.T
    assert {(r.a, r.b) for r in sparse.sparse_pairs(rows, 2.0).collect()} == {(i, j) for i in range(120) for j in range(i + 1, 120) if dots[i, j] >= 2.0}
    assert sparse.sparse_pairs(rows.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError, match="above 0"):
        sparse.sparse_pairs(rows, 0.0)


def names(n, seed):
    r = random.Random(seed)
    words = ["arthur", "king", "cove", "kynance", "harbour", "lantern", "bay", "the", "of", "pascoe", "tregear", "x" * 210]
    out = {" ".join(r.choice(words) for _ in range(r.randrange(1, 6))) for _ in range(n)}
    return sorted(out | {"".join(r.choice("abcd ") for _ in range(r.randrange(3, 9))).strip() or "q" for _ in range(n)})


def test_names_of_several_words_are_bounded(spark):
    own = names(70, 3)
    pairs = [(x, y) for i, x in enumerate(own) for y in own[i + 1 :]]
    a, b = (np.array(c, object) for c in zip(*pairs, strict=True))
    may = entities.names_may_agree(0.72)(a, b)
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", entities.name_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    agree, kept = {(r.a, r.b) for r in rows if r.s >= 0.72}, {p for p, ok in zip(pairs, may, strict=True) if ok}
    assert agree <= kept and len(kept) < len(pairs) / 2 and any(" " in x for x, _ in set(pairs) - kept)
    assert len(entities.names_may_agree(0.72)(a[:0], b[:0])) == 0


def test_links_are_those_of_all_pairs(spark):
    own = names(60, 5)
    table = spark.createDataFrame([(n, "t" if len(n) % 2 else "u") for n in own], "cluster string, entity_type string").withColumn("embedding", providers.hashed_embedder(64)(F.col("cluster")))
    got = {(r.a, r.b) for r in entities.name_links(table, 0.9, 0.72).collect()}
    x, y = table.alias("x"), table.alias("y")
    every = x.join(y, (F.col("x.entity_type") == F.col("y.entity_type")) & (F.col("x.cluster") < F.col("y.cluster"))).select(F.col("x.cluster").alias("a"), F.col("y.cluster").alias("b"), F.col("x.embedding").alias("v"), F.col("y.embedding").alias("w"))
    every = every.withColumn("s", entities.name_similarity(F.col("a"), F.col("b"))).collect()
    want = {(r.a, r.b) for r in every if r.s >= 0.72 and np.dot(np.float64(r.v), np.float64(r.w)) >= 0.9}
    assert got == want and want


# snapshots


def test_versions(spark):
    store = Snapshots(spark, shared_path(spark, "versions"))
    assert store.latest().version == 0 and store.latest().read("t", "a int").count() == 0 and store.expire() == []
    change = store.change()
    change.append("t", spark.range(3))
    change.append("t", spark.range(2))
    assert change.read("t").count() == 5 and store.latest().version == 0  # nobody else sees it
    first = change.commit()
    assert first.version == 1 and store.latest().read("t").count() == 5
    other, late = store.change(), store.change()
    other.replace("t", spark.range(1))
    other.append("u", spark.range(4))
    late.append("t", spark.range(9))
    other.commit()
    with pytest.raises(Conflict):
        late.commit()
    assert store.latest().read("t").count() == 1 and store.at(1).read("t").count() == 5 and not store.at(1).has("u")
    with pytest.raises(KeyError):
        store.at(1).read("u")
    killed = store.change()
    killed.append("t", spark.range(100))  # and never commits
    third = store.change()
    third.append("t", spark.range(1))
    third.commit()
    assert store.latest().read("t").count() == 2
    assert store.expire(2) == [1] and store.versions() == [2, 3]
    assert store.at(2).read("t").count() == 1 and store.latest().read("u").count() == 4
    assert not any("t-" in n for d in store.files.names("data") if d.startswith(f"{killed.version:012d}") for n in store.files.names(f"data/{d}") if f"data/{d}/{n}" not in third.tables["t"]["paths"])


def test_many_appends_are_merged(spark, monkeypatch):
    monkeypatch.setattr("skein.sources.snapshots.MERGE_FROM", 4)
    store = Snapshots(spark, shared_path(spark, "merged"))
    for _ in range(6):
        change = store.change()
        change.append("t", spark.range(2))
        change.commit()
    assert store.latest().read("t").count() == 12 and len(store.latest().tables["t"]["paths"]) < 4


# the engine over versions

TEXTS = [
    "The harbour of Lantern Bay was built by engineer Morwenna Pascoe. She lived near the harbour for thirty years and drew every quay herself.",
    "Morwenna Pascoe studied mathematics in Truro before the harbour was planned. Her teacher was Jowan Tregear of the college there.",
    "Jowan Tregear wrote a treatise on tides and currents. The treatise was printed in Truro by a small college press.",
    "Bread is baked from flour, water and salt in most villages. The oven is heated with gorse before dawn every morning.",
    "A lighthouse keeper at Lantern Bays wrote letters about the harbours and the villagers. The letters were printed in Truro.",
    "Villages near the harbour bake their bread with sea salt. The keeper of the lighthouse wrote about treatises on tides.",
]
CONFIG = Config(top_k=2, conductance_floor=0.05, unit_min_words=5)


def said(texts):
    found = []
    for t in texts:
        low = t.lower()
        found.append([{"text": w, "type": "thing", "description": d} for w, d in (("Lantern Bay", "a harbour"), ("Lantern Bays", "a harbour"), ("harbour", "a port"), ("harbours", "a port"), ("Truro", "a city"), ("Tregear", "a teacher"), ("bread", "food"), ("lighthouse", "a tower"), ("treatise", "a book"), ("treatises", "a book")) if w.lower() in low])
    return found


@pytest.mark.parametrize("extractor", [providers.salient_terms, providers.extraction_provider(said)])
def test_a_second_index_equals_a_full_build(spark, extractor):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    grown, whole = (Engine(spark, shared_path(spark, f"kept{i}"), CONFIG, extractor) for i in range(2))
    for n in (3, 6):
        grown.index(docs.limit(n))
    whole.index(docs)
    columns = {"entities": None, "support": ["mention_id", "entity_id", "passage_id", "su_id"], "incidence": None, "passage_entity": None, "idf": None, "passages": ["id"], resolution.LABELS: None, resolution.LINKS: None}
    for table, some in columns.items():
        x, y = (sorted(map(str, e.table(table).select(*(some or sorted(e.table(table).columns))).collect())) for e in (grown, whole))
        assert x == y and (x or table.startswith("name_")), table
    assert whole.changes["rebuilt"] == whole.changes["clusters"]
    grown.index(docs)
    assert grown.changes == {"changed": 0, "rebuilt": 0, "clusters": whole.changes["clusters"]}


def test_only_touched_clusters_are_made(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    e = Engine(spark, shared_path(spark, "touched"), CONFIG, providers.extraction_provider(said))
    e.index(docs.limit(4))
    before = e.changes["clusters"]
    e.index(spark.createDataFrame([("Sea salt and bread are sold at the market of the town on Fridays.",)], "text string"))
    assert e.changes == {"changed": 1, "rebuilt": 1, "clusters": before}


def test_readers_keep_their_version(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    folder = shared_path(spark, "pinned")
    e = Engine(spark, folder, CONFIG)
    first = e.index(docs.limit(3))
    old = Engine(spark, folder, CONFIG, version=first.version)
    q = spark.createDataFrame([(1, "Who planned the harbour with Pascoe?")], "query_id long, question string")
    seen = sorted(map(tuple, old.retrieve(q).collect()))

    def fails(units):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        Engine(spark, folder, CONFIG, fails).index(docs)
    assert e.snapshot().version == first.version and e.passages.read().count() == 3
    assert e.index(docs).version == first.version + 1 and e.passages.read().count() == 6
    assert old.passages.read().count() == 3 and sorted(map(tuple, old.retrieve(q).collect())) == seen
    e.snapshots.expire(1)
    assert e.retrieve(q).count() == 2 and e.snapshots.versions() == [first.version + 1]


def test_passages_without_units_are_cut_once(spark):
    e = Engine(spark, shared_path(spark, "empty"), CONFIG)
    docs = spark.createDataFrame([(TEXTS[0],), ("  ",)], "text string")
    e.index(docs)
    e.index(docs)
    assert e.table("cut_passages").count() == 2 == e.passages.read().count()


def test_long_names_are_found(spark):
    from skein.operators import mentions

    nodes = spark.createDataFrame([(["l'a d'b e'f g'h i'j"], "name"), (["truro", "truro city"], "place")], "aliases array<string>, entity_type string")
    q = spark.createDataFrame([(1, "Who met l'a d'b e'f g'h i'j in Truro City?"), (2, None)], "query_id long, question string")
    found = {(r.query_id, r.surface_text, r.entity_type) for r in mentions.known_names(q, nodes).collect()}
    assert found == {(1, "l a d b e f g h i j", "name"), (1, "truro", "place"), (1, "truro city", "place")}
    assert mentions.known_names(q, nodes.limit(0)).count() == 0


def test_names_near_loses_no_pair_and_keeps_few(spark):
    own = names(90, 7) + ["y" * 70, "y" * 69 + "z", "überall", "überalle"]
    x, y = np.array(own[::2] + own[:9], object), np.array(own[1::2] + own[:9], object)
    p, q = entities.names_near(0.72)(x, y)
    near = set(zip(p.tolist(), q.tolist(), strict=True))
    rows = [(i, j, a, b) for i, a in enumerate(x) for j, b in enumerate(y)]
    s = spark.createDataFrame(rows, "i int, j int, a string, b string").select("i", "j", entities.name_similarity(F.col("a"), F.col("b")).alias("s"))
    agree = {(r.i, r.j) for r in s.collect() if r.s >= 0.72}
    before = entities.names_may_agree(0.72)(np.array([r[2] for r in rows], object), np.array([r[3] for r in rows], object)).sum()
    assert agree <= near and len(near) == len(p) and len(near) < (before + len(agree)) / 2
    keys = [np.array(["c\x1f" + n for n in side], object) for side in (x, y)]
    assert [c.tolist() for c in entities.names_near(0.72, True)(*keys)] == [p.tolist(), q.tolist()]
    assert len(entities.names_near(0.72)(x[:0], y)[0]) == 0


@pytest.mark.parametrize("held", [2, 500_000])
def test_contracted_edges_have_the_same_components(spark, monkeypatch, held):
    from skein.operators import components

    monkeypatch.setattr(components, "HELD", held)
    r = random.Random(4)
    rows = [(f"n{i:03}", f"n{i + 1:03}", i // 20) for i in range(99) if i % 33] + [(f"n{r.randrange(60):03}", f"n{r.randrange(60):03}", 9) for _ in range(15)]
    edges = spark.createDataFrame(rows, "a string, b string, at int")
    want = sorted(tuple(x) for x in components.connected_components(edges).collect())
    few = components.contracted(edges, "at")
    assert sorted(tuple(x) for x in components.connected_components(few).collect()) == want and few.count() <= len(rows)


def test_merging_by_kinds_is_merging_by_mentions(spark):
    r, own = random.Random(8), names(50, 9)
    rows = [(f"p{i % 7}", f"u{i % 23}", f"m{i}", r.choice(own), "term", r.choice(["a bay", "a cove", ""]), r.choice(["Bay", "cove"])) for i in range(400)]
    found = spark.createDataFrame(rows, "passage_id string, su_id string, mention_id string, normalized_name string, entity_type string, description string, surface_text string").cache()
    m = entities.normalised(found).cache()
    labels = connected_components(entities.name_links(entities.name_vectors(m, 256), 0.9, 0.72))
    nodes, owners = entities.canonical(m, labels, 256)
    got, edges = entities.merge_mentions(found)
    columns = sorted(c for c in nodes.columns if c != "cluster")
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, nodes.select(columns).collect())) and got.count() < len(own)
    assert sorted(edges.collect()) == sorted(owners.drop("cluster").collect())
