"""The pipeline against its stages' brute-force definitions, and that its queries are registered."""

import __spark_entry__
import corpus_pipeline
from skein.llm import pii, pii_model
from skein.llm._shared import written
from tests.llm.test_text_operators import SF, brute_components, brute_contamination
from tests.llm.test_tokens import check_packing


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = stages[0](spark, docs, SF)
    assert kept.columns == docs.columns
    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    one = stages[1](spark, kept, SF)
    comps = brute_components([r.text for r in rows])
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == [rows[i].doc_id for i, _, c in comps if i == c]
    clean = stages[2](spark, one, SF)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in one.collect() if not brute_contamination(r.text, items)[4])
    private = stages[3](spark, clean, SF)
    assert private.columns == docs.columns
    model, before = pii_model.default_model(), {r.doc_id: r.text for r in clean.collect()}
    for r in private.collect():  # each span of its own gone, base ones and the model's
        assert r.text == pii.redacted(before[r.doc_id], pii.all_spans(model, [before[r.doc_id]])[0]) and r.n_chars == len(r.text)
    packed = stages[4](spark, private, SF).collect()
    bins, least = check_packing(private.collect(), 4096, packed)
    assert bins <= least + 1
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_odd_rows(spark):
    """Nulls, repeats, ties, an empty table and columns of clashing names go through all stages."""
    source = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text][:150]
    more = ("n_words", "kept", "spans", "contaminated", "__h", "piece", "hash")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, "k", "s", "c", "h", 2, 3) for r in source]
    odd = [(None, source[0].text), (None, source[3].text + " more words at the end"), (5, None), (None, None), (source[1].doc_id, source[1].text), (source[2].doc_id, source[4].text.upper()), (7, ""), (8, " ".join(f"w{i % 5000}" for i in range(60_000)))]
    rows += [(i, t, None, None, None, None, None, None, None, None, None, None) for i, t in odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` {k}" for c, k in zip(more, ("int", "string", "string", "string", "string", "int", "int"), strict=True)))
    for table in (docs, docs.limit(0)):
        now = table
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, SF)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
                now = written(out, "odd")
                assert now.where("n_words <> 1 or kept <> 'k' or spans <> 's' or contaminated <> 'c' or __h <> 'h' or piece <> 2 or hash <> 3").count() == 0
            else:
                packed = out.collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in now.collect()}
        assert (now.count() > 50) == (table is docs)


def test_registered():
    names = __spark_entry__.queries()
    assert [sum(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
