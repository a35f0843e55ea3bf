"""Chunking, entities, expansion and fusion against hand-checked values and brute force; the engine from end to end."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.config import Config
from skein.core import shared_path
from skein.engine import Engine
from skein.functions import providers
from skein.functions import text as X
from skein.functions.providers import embed
from skein.operators import chunking, entities, graph, mentions, retrieval
from skein.operators.similarity import similar_pairs, top_k
from skein.plans import benchmark, planner, qa
from skein.sources import files
from skein.sources.store import Store
from skein.streaming.ingest import stream_into


def test_percentile_groups(spark):
    rows = spark.createDataFrame([(1, i, d) for i, d in enumerate([0.1, 0.5, 0.2, 0.9, 0.35, None])], "g int, pos int, distance double")
    got = chunking.percentile_groups(rows, "g", ["pos"], 60).orderBy("pos").collect()
    assert [r.unit_no for r in got] == [0, 0, 1, 1, 2, 2] and got[0].threshold == pytest.approx(0.41)


def test_fixed_windows(spark):
    words = [str(i) for i in range(25)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a b"), (3, ""), (4, None)], "id int, text string")
    got = {(r.id, r.chunk_no): r.text.split() for r in chunking.fixed_windows(docs, "id", "text", 10, 4).collect()}
    assert got == {(1, 0): words[:10], (1, 1): words[6:16], (1, 2): words[12:22], (1, 3): words[18:25], (2, 0): ["a", "b"]}


def test_semantic_cuts():
    assert chunking.semantic_cuts([5, 5], [0.1, 0.0], 100) == [(0, 2)]
    # boundaries between 8 and 12 tokens: after the third and the fourth sentence; the wider gap wins
    assert chunking.semantic_cuts([3, 3, 3, 3, 3, 3], [0.9, 0.1, 0.2, 0.6, 0.0, 0.0], 10) == [(0, 4), (4, 6)]
    # a sentence that is too long stands alone
    assert chunking.semantic_cuts([50, 3, 3], [0.1, 0.2, 0.0], 10) == [(0, 1), (1, 3)]


def test_balanced():
    v = np.eye(4)[[0, 0, 1, 1, 2]]
    # the short last unit joins the left one for want of another; the long one is cut at its only wide gap
    assert chunking.balanced([[0, 1], [2, 3], [4]], [20, 20, 20, 20, 3], v, 20, 200) == [[0, 1], [2, 3, 4]]
    assert chunking.balanced([[0, 1, 2, 3]], [30, 30, 30, 30], v, 20, 100) == [[0, 1], [2, 3]]
    assert chunking.balanced([[0]], [3], v[:1]) == [[0]]


def test_units_keep_all_sentences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    units = chunking.semantic_units(docs, "doc_id", "text").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("u"))
    cut = {r.doc_id: r.s for r in docs.select("doc_id", chunking.X.sentences(F.col("text")).alias("s")).collect()}
    for r in units.collect():
        if len(cut[r.doc_id]) > 1:
            assert " ".join(u.text for u in r.u) == " ".join(cut[r.doc_id])


def hypergraph(spark):
    inc = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (3, 2)], "entity_id long, su_id long")
    units = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.6, 0.8])], "su_id long, embedding array<double>")
    entities = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "entity_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    seeds = spark.createDataFrame([(7, 0, 0, 1.0)], "query_id long, ord int, entity_id long, score double")
    return inc, units, entities, q, seeds


@pytest.mark.parametrize(("alpha", "want"), [(1.0, [1.0, 0.5, 0.075, 0.001875]), (0.7, [1.0, 0.5, 0.099642, 0.006617])])
def test_expansion_and_fusion(spark, alpha, want):
    inc, units, entities, q, seeds = hypergraph(spark)
    active = retrieval.expand(inc, units, q, seeds, entities, Config(steering_alpha=alpha))
    got = {r.entity_id: r.score for r in active.collect()}
    assert [got[i] for i in range(4)] == pytest.approx(want, abs=2e-6)
    places = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2), (2, 3)], "passage_id long, entity_id long")
    weights = graph.passage_weights(places)
    passages = spark.createDataFrame([(i, [s, math.sqrt(1 - s * s)]) for i, s in enumerate((0.9, 0.5, 0.3, 0.8))], "passage_id long, embedding array<double>")
    out = retrieval.fuse(active, weights, graph.idf(weights, 4), passages, q, 0.5, None).orderBy("rank").collect()
    assert [r.passage_id for r in out] == [0, 3, 1, 2]
    scores = {1.0: [1.0, 0.444444, 0.407778, 0.167417], 0.7: [1.0, 0.444444, 0.417635, 0.169313]}[alpha]
    assert [r.score for r in out] == pytest.approx(scores, abs=2e-6)


def test_expansion_edges(spark):
    inc, units, entities, q, seeds = hypergraph(spark)
    two = seeds.union(spark.createDataFrame([(7, 1, 0, -0.5)], seeds.schema))
    assert [(r.entity_id, r.score) for r in retrieval.expand(inc, units, q, two, entities).collect()] == [(0, -0.5)]  # the later score, which does not spread
    assert retrieval.expand(inc, units, q, seeds, entities, Config(max_hops=0)).count() == 1
    assert retrieval.expand(inc.limit(0), units, q, seeds, entities).count() == 1
    gates = spark.createDataFrame([(7, [0.6, 0.8]), (7, [1.0, 0.0])], "query_id long, embedding array<double>")
    got = {r.entity_id: r.score for r in retrieval.expand(inc, units, q, seeds, None, Config(), gates).collect()}
    assert got[1] == pytest.approx(0.5) and got[2] > 0.075


def test_search_and_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else "cold", v[i].tolist()) for i in range(300)], "id long, kind string, embedding array<double>")
    q = rows.where("id % 100 = 0").selectExpr("id query_id", "embedding")
    got = {(r.query_id, r["rank"]): r.id for r in top_k(rows.repartition(7), q, 4).collect()}
    assert got == {(i, k + 1): int(j) for i in (0, 100, 200) for k, j in enumerate(np.argsort(-(v @ v[i]), kind="stable")[:4])}
    monkeypatch.setattr("skein.operators.similarity.QUERY_BYTES", 8 * 8 * 20)  # twenty queries a turn
    many = rows.selectExpr("id query_id", "embedding")
    got = {(r.query_id, r["rank"]): r.id for r in top_k(rows, many, 2).collect()}
    assert got == {(i, k + 1): int(j) for i in range(300) for k, j in enumerate(np.argsort(-(v @ v[i]), kind="stable")[:2])}
    pairs = {(r.a, r.b) for r in similar_pairs(rows, 0.8).collect()}
    cos = v @ v.T
    assert pairs == {(i, j) for i in range(300) for j in range(i + 1, 300) if (i % 3 > 0) == (j % 3 > 0) and cos[i, j] >= 0.8}
    assert similar_pairs(rows.limit(0), 0.5).count() == 0 and top_k(rows, q.limit(0), 3).count() == 0


def test_store_and_stream(spark, tmp_path):
    store = Store(spark, shared_path(spark, "store"), "passage-", lambda c: F.array(F.length(c).cast("float")))
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string")
    store.upsert(texts)
    store.upsert(texts.union(spark.createDataFrame([("c",)], "text string")))
    assert sorted(r.text for r in store.read().collect()) == ["a", "b", "c"]
    texts.union(spark.createDataFrame([("d",)], "text string")).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").json(str(tmp_path / "in"))
    stream_into(stream, store, str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r.text for r in store.read().collect()) == ["a", "b", "c", "d"]
    store.clear()
    assert store.read().count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"corpus_name": "m", "context": "text"}')
    (tmp_path / "many.json").write_text('[{"corpus_name": "a", "context": "x"}, {"corpus_name": "b", "context": "y"}]')
    assert files.read_corpus(spark, str(tmp_path / "one.json")).count() == 1 and files.read_corpus(spark, str(tmp_path / "many.json")).count() == 2
    (tmp_path / "q.json").write_text('[{"id": "1", "source": "a", "question": "q", "answer": "x"}, {"id": "2", "source": "z", "question": "q", "question_type": "t"}]')
    q = files.read_questions(spark, str(tmp_path / "q.json"))
    assert {tuple(r) for r in files.question_types(q).collect()} == {("unknown", 1), ("t", 1)}
    assert files.select_questions(q, types=["t"], limit=1).count() == 1
    both, alone = files.shared_sources(q, files.read_corpus(spark, str(tmp_path / "many.json")))
    assert [r[0] for r in both.collect()] == ["a"] and [r[0] for r in alone.collect()] == ["z"]
    assert files.newest_snapshot(spark, str(tmp_path)).endswith("q.json")


def test_engine(spark):
    texts = [
        "The harbour of Lantern Bay was built by engineer Morwenna Pascoe. She lived near the harbour for thirty years and drew every quay herself.",
        "Morwenna Pascoe studied mathematics in Truro before the harbour was planned. Her teacher was Jowan Tregear of the college there.",
        "Jowan Tregear wrote a treatise on tides and currents. The treatise was printed in Truro by a small college press.",
        "Bread is baked from flour, water and salt in most villages. The oven is heated with gorse before dawn every morning.",
    ]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    e = Engine(spark, shared_path(spark, "engine"), Config(top_k=2, conductance_floor=0.05, unit_min_words=5))
    e.index(docs.limit(2))
    e.index(docs)
    e.index(docs)
    assert e.passages.read().count() == 4
    assert e.table("incidence").count() > 0 and e.table("entities").select("entity_id").distinct().count() == e.table("entities").count()
    questions = spark.createDataFrame([(1, "Who planned the harbour with Pascoe and Tregear?"), (2, "zzz qqq")], "query_id long, question string")
    got = e.retrieve(questions)
    assert {(r.query_id, r["rank"]) for r in got.collect()} == {(q, k) for q in (1, 2) for k in (1, 2)}
    answered = {r.query_id: r for r in e.rag_qa(questions).collect()}
    assert answered[1].answer and len(answered[1].passages) == 2 and "Question: Who planned" in answered[1].prompt
    e.register_views("skein_")
    assert spark.sql("select count(*) from skein_entities").first()[0] > 0


def test_default_embedding():
    v = embed(["a b a", "", None], 16)
    assert np.linalg.norm(v[0]) == pytest.approx(1) and not v[1:].any()


def test_mentions_of_recurring_terms_stay_as_tables_grow(spark):
    for n in (100, 1000):  # every twentieth unit holds the term, every second one the common word
        rows = [("p", f"s{i}", f"unit{i:05d} {'recurring' if i % 20 == 0 else ''} {'common' if i % 2 else ''}") for i in range(n)]
        found = providers.salient_terms(spark.createDataFrame(rows, "passage_id string, su_id string, text string")).groupBy("surface_text").count().collect()
        assert [tuple(r) for r in found] == [("recurring", n // 20)]


def test_places_are_those_of_whole_tokens(spark):
    rows = [("p", "s1", "thereby it was there"), ("p", "s2", "There, there"), ("q", "s3", None)]
    found = providers.salient_terms(spark.createDataFrame(rows, "passage_id string, su_id string, text string")).collect()
    assert {(r.su_id, r.surface_text, r.char_start, r.char_end) for r in found} == {("s1", "there", 15, 20), ("s2", "there", 0, 5)}


def slow_balanced(groups, words, vectors, least, most):
    """The rule step by step, counting and averaging anew each time."""
    groups, count = [list(g) for g in groups], lambda g: sum(words[i] for i in g)

    def like(a, b):
        x, y = (vectors[g].mean(0) for g in (a, b))
        return float(x @ y / max(np.linalg.norm(x), 1e-8) / max(np.linalg.norm(y), 1e-8))

    while len(groups) > 1:
        i = min(range(len(groups)), key=lambda j: (count(groups[j]), j))
        if count(groups[i]) >= least:
            break
        left, right = like(groups[i - 1], groups[i]) if i else -1.0, like(groups[i + 1], groups[i]) if i + 1 < len(groups) else -1.0
        j = i - 1 if left >= right else i
        groups[j : j + 2] = [groups[j] + groups[j + 1]]
    out = []

    def cut(g):
        ok = [k for k in range(1, len(g)) if count(g) > most and count(g[:k]) >= least and count(g[k:]) >= least]
        if not ok:
            out.append(g)
            return
        k = max(ok, key=lambda k: (round(1 - float(vectors[g[k - 1]] @ vectors[g[k]]), 9), -k))
        cut(g[:k])
        cut(g[k:])

    for g in groups:
        cut(g)
    return out


def test_balanced_keeps_the_rule():
    rng = np.random.default_rng(8)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        v = rng.random((n, 6))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        words, edges = rng.integers(1, 60, n).tolist(), np.flatnonzero(rng.random(n - 1) < 0.6) + 1
        groups = [list(g) for g in np.split(np.arange(n), edges)]
        assert [list(map(int, g)) for g in chunking.balanced(groups, words, v, 20, 90)] == [list(map(int, g)) for g in slow_balanced(groups, words, v, 20, 90)]


def test_fusion_scores_no_more_than_it_must(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    passages = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "passage_id long, embedding array<double>")
    questions = passages.where("passage_id < 4").selectExpr("passage_id query_id", "embedding")
    active = spark.createDataFrame([(q, e, float(1 + q + e) / 10) for q in range(3) for e in range(5)], "query_id long, entity_id long, score double")
    weights = spark.createDataFrame([(int(p), e) for e in range(5) for p in rng.choice(60, 6, replace=False)], "passage_id long, entity_id long")
    idf = graph.idf(graph.passage_weights(weights), 60)
    for k in (1, 5, 30):
        some = {(r.query_id, r["rank"]): (r.passage_id, round(r.score, 9)) for r in retrieval.fuse(active, weights, idf, passages, questions, 0.7, k).collect()}
        every = {(r.query_id, r["rank"]): (r.passage_id, round(r.score, 9)) for r in retrieval.fuse(active, weights, idf, passages, questions, 0.7, None).collect() if r["rank"] <= k}
        assert some == every and len(some) == 3 * k


def test_only_new_units_are_read(spark, tmp_path):
    log = tmp_path / "asked"

    def extract(texts, log=str(log)):
        with open(log, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        if any("poison" in t for t in texts):
            raise RuntimeError("no answer")
        return [[{"text": w, "type": "place", "description": "a place"} for w in ("Lantern Bay", "Truro") if w in t] for t in texts]

    first = ["The harbour of Lantern Bay was built long ago by people from Truro.", "Truro has a college where mathematics is taught each winter."]
    docs = spark.createDataFrame([(t,) for t in first], "text string")
    more = docs.union(spark.createDataFrame([("A poisonous text about poison that fails whenever it is read aloud.",), ("Lantern Bay has a new lighthouse on the northern quay.",)], "text string"))
    e = Engine(spark, shared_path(spark, "cached"), Config(top_k=2, conductance_floor=0.05, unit_min_words=3), extractor=providers.extraction_provider(extract))
    e.index(docs)
    asked = log.read_text().splitlines()
    assert sorted(set(asked)) == sorted(first)
    e.index(docs)
    assert log.read_text().splitlines() == asked  # nothing was asked again
    e.index(more)
    later = log.read_text().splitlines()[len(asked) :]
    assert not set(later) & set(first) and any("lighthouse" in t for t in later)
    found = {(r.normalized_name, r.grounded) for r in e.table("mentions").collect()}
    assert found == {("lantern bay", True), ("truro", True)}
    nodes = {r.canonical_name: r for r in e.table("entities").collect()}
    assert nodes["lantern bay"].su_count == 2 and nodes["truro"].mention_count == 2
    assert entities.supporting(e.table("support")).where(F.col("entity_id") == nodes["truro"].entity_id).count() == 2
    seeds = e.seeds(spark.createDataFrame([(1, "Who lives in Lantern  Bay, and who in TRURO?")], "query_id long, question string")).collect()
    assert {r.canonical_name for r in seeds} == {"lantern bay", "truro"}


def test_providers_answer_and_fail_alone(spark):
    def infer(p):
        if "bad" in p:
            raise RuntimeError
        return "Thought: x Answer: " + p[:3]

    rows = spark.createDataFrame([("one two",), ("bad",), (None,)], "p string")
    assert [r[0] for r in rows.select(providers.chat_provider(infer)(F.col("p"))).collect()] == ["Thought: x Answer: one", "", "Thought: x Answer: "]

    def score(pairs):
        if len(pairs) > 1 or "<Document>: bad" in pairs[0]:
            raise RuntimeError
        return [float(len(pairs[0]))]

    got = [r[0] for r in rows.where("p is not null").select(providers.pair_provider(score)(F.lit("q"), F.col("p"))).collect()]
    assert got[0] > 0 and got[1] == 0
    assert spark.range(1).select(X.rerank_pair("i", F.lit("q"), F.lit("x" * 50), 11)).first()[0] == "<Instruct>: i\n<Query>: q\n<Document>: " + "x" * 10
    verdicts = spark.createDataFrame([("a", "a"), ("b", "c")], "pred_answer string, gold_answer string")
    rows, means = qa.evaluate(verdicts, providers.chat_provider(lambda p: " Correct" if "Answer: a" in p else "incorrect"))
    assert sorted(r.llm_accuracy for r in rows.collect()) == [0, 1] and means.first().llm_accuracy == 0.5
    assert providers.hosted_key("local", None) is None and providers.hosted_key("gpt-x", "k") == "k"
    with pytest.raises(ValueError, match="API key"):
        providers.hosted_key("gpt-x", "")
    said = spark.range(1).select(planner.messages(F.lit("why?"), 3)).first()[0]
    assert '"role":"system"' in said and "max_subqueries" in said
    assert qa.messages(spark.createDataFrame([("p",)], "prompt string")).first().messages.count("content") == 2


CORPUS = (
    '[{"corpus_name": "bay", "context": "The harbour of Lantern Bay was built by Morwenna Pascoe. She lived near the harbour for thirty years. Morwenna Pascoe drew every quay herself."},'
    ' {"corpus_name": "idle", "context": "Nobody asks about this one."}]'
)


def test_benchmark_runs(spark, tmp_path):
    (tmp_path / "corpus.json").write_text(CORPUS)
    (tmp_path / "questions.json").write_text('[{"id": "q1", "source": "bay", "question": "Who built the harbour?", "answer": "Morwenna Pascoe"}, {"id": "q2", "source": "gone", "question": "What?", "answer": "x", "question_type": "t"}]')
    (tmp_path / "chunks.json").write_text('["The harbour of Lantern Bay was built by Morwenna Pascoe.", "Bread is baked before dawn."]')
    made = benchmark.run_corpora(spark, str(tmp_path / "corpus.json"), str(tmp_path / "questions.json"), str(tmp_path / "out"), Config(top_k=2)).collect()
    assert [(r.id, r.source, r.ground_truth) for r in made] == [("q1", "bay", "Morwenna Pascoe")] and made[0].generated_answer and made[0].context
    assert spark.read.json(str(tmp_path / "out/predictions")).count() == 1
    with pytest.raises(ValueError, match="no corpus entry"):
        benchmark.run_corpora(spark, str(tmp_path / "corpus.json"), str(tmp_path / "questions.json"), str(tmp_path / "out2"), entry="nothing")
    with pytest.raises(FileNotFoundError):
        benchmark.run_corpora(spark, str(tmp_path / "none.json"), str(tmp_path / "questions.json"), str(tmp_path / "out2"))
    rows = benchmark.run_chunks(spark, str(tmp_path), str(tmp_path / "chunked"), Config(top_k=1), limit=1)
    assert [r.contain_accuracy for r in rows.collect()] == [1]
    assert files.read_predictions(spark, str(tmp_path / "chunked/predictions")).first().sorted_passage[0].startswith("0:The harbour")
    assert spark.read.json(str(tmp_path / "chunked/evaluation")).first().contain_accuracy == 1


def test_no_pair_of_names_is_lost(spark):
    rng = np.random.default_rng(6)
    names = sorted({"".join(rng.choice(list("abcde "), rng.integers(3, 10))).strip() for _ in range(120)} | {"king arthur", "arthur", "kynance", "kynance cove", "hodgkin", "hodgkins"})
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    a, b = (np.array(c, object) for c in zip(*pairs, strict=True))
    may = entities.names_may_agree(0.72)(a, b)
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", entities.name_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    agree = {(r.a, r.b) for r in rows if r.s >= 0.72}
    assert agree <= {p for p, ok in zip(pairs, may, strict=True) if ok} and 0 < may.sum() < len(pairs)


def test_shared_folder_is_named_in_full(spark, monkeypatch):
    from skein import core

    assert core.shared_path(spark, "t").startswith("file:/") and core.shared_path(spark, "t") != core.shared_path(spark, "t")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: None)  # where no folder is set
    own = core.shared_folder(spark)
    assert own.startswith("file:/") and own == core.shared_folder(spark)
    monkeypatch.undo()
    assert core.is_small(core.written(spark.range(10), "t")) and not core.is_small(core.written(spark.range(10), "t"), rows=5)


def test_task_counts(spark):
    from skein import core

    scan = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert core.task_count(scan, 1 << 20) == -(-core.plan_bytes(scan) // (1 << 20)) > 8 and core.task_count(scan) == 8  # two a core
    unknown = spark.createDataFrame([(1,)], "a int")
    assert core.task_count(unknown) == core.task_count(unknown.crossJoin(scan)) == 8  # the shuffle partitions of these tests are fewer


def test_unit_counts_keep_sentences(spark):
    from skein.queries import ORACLES

    texts = ["One two three four. Five six seven eight! Nine ten eleven twelve? One two three four five.", "short", " ", None, "A single sentence that is long enough."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    units = {r[0]: r[1] for r in chunking.semantic_units(docs, "doc_id", "text", 60.0, 0, 1 << 40, 64).groupBy("doc_id").count().collect()}
    got = {r[0]: (r[1], r[2]) for r in chunking.unit_counts(docs, "doc_id", "text", 60.0, 0, 1 << 40, 64).collect()}
    assert {k: v[0] for k, v in got.items()} == units and {k: v[1] for k, v in got.items()} == {0: 4, 1: 0, 4: 1}
    assert "n_sentences" in ORACLES["c05_semantic_units"]


def test_terms_named_once_are_the_mentions(spark, monkeypatch):
    from skein.operators import mentions

    rows = [("p", "u", "Alpha's betas, gamma"), ("p", "u", "gamma delta alpha"), ("p", "v", "delta betas ALPHA entity"), ("q", "w", "entity _betas_ delta")]
    units = spark.createDataFrame(rows, "passage_id string, su_id string, text string")
    for some in (units, units.where("text not like 'gamma%'")):  # units with two texts, and with one each
        per_mention = mentions.mention_records(providers.salient_terms(some)).collect()
        seen = []
        once = providers.salient_terms(some, named=lambda found: seen.append(found.count()) or mentions.named(found))
        assert sorted(map(str, mentions.mention_records(once).select(*per_mention[0].__fields__).collect())) == sorted(map(str, per_mention))
        assert seen == [len({r.surface_text for r in providers.salient_terms(some).collect()})]


def test_idf_tasks_grow_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS_AT_ONCE", 2)
    pairs = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 2), (None, 3)] * 10, "passage_id long, entity_id long")
    got = graph.idf(pairs, 4, 50)
    assert {r.entity_id: r.df for r in got.collect()} == {1: 2, 2: 1, 3: 0}
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString() and ", 25)" in got._jdf.queryExecution().toString()


def test_maxima_are_broadcast(spark):
    from skein.operators import retrieval

    rows = spark.createDataFrame([(1, 0.5), (1, 0.25), (2, -1.0), (2, -2.0)], "query_id long, score double")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = retrieval.over_maximum(rows, "score", "scaled")
        assert sorted(map(tuple, got.collect())) == [(1, 0.25, 0.5), (1, 0.5, 1.0), (2, -2.0, -2.0), (2, -1.0, -1.0)]
        assert "SortMergeJoin" not in got._jdf.queryExecution().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_names_are_normalised_once_each(spark, monkeypatch):
    seen, plain = [], entities.join_checked
    monkeypatch.setattr(entities, "join_checked", lambda df, side, *on: seen.append((df.count(), side.count())) or plain(df, side, *on))
    rows = [(f"p{i}", f"u{i}", "Alpha", "the alpha", "term", "alpha", f"m{i}") for i in range(5)] + [("p0", "u0", "It", "it", "term", "it", "m9"), ("p1", "u1", "Beta", "beta", "term", None, "m8")]
    found = spark.createDataFrame(rows, "passage_id string, su_id string, surface_text string, normalized_name string, entity_type string, description string, mention_id string")
    got = entities.normalised(found)
    assert got.columns == found.columns and seen == [(7, 2)]
    assert sorted((r.normalized_name, r.description, r.mention_id) for r in got.collect()) == [("alpha", "alpha", f"m{i}") for i in range(5)] + [("beta", "beta", "m8")]
