"""Columns of any name pass the operators; salts and licence digests."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import decontaminate, licenses, neighbour_vote, ngram_join, packing, pii, quality_rules, token_counts
from skein.llm import queries as registry
from skein.llm._shared import written

SF = "/root/testdata/sf0.001"
ODD = ("__key", "__h", "__n", "__bad_id", "__own_hash", "__own", "__text", "__digest", "__id", "foreign")


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    return written(table.withColumns({c: F.concat(F.lit(c), "doc_id") for c in ODD}), "odd-columns")


def kept(out):
    rows = out.select("doc_id", *ODD).collect()
    return rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in ODD)


def test_operators_keep_columns_of_any_name(spark, docs):
    items, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("benchmark", "labels"))
    for out in (
        quality_rules.judged(docs), quality_rules.reject_outliers(docs), decontaminate.contamination(docs, items), decontaminate.decontaminate(docs, items), ngram_join.keep_one(docs), licenses.scan(docs),
        pii.redact(docs), token_counts.count_tokens(docs), neighbour_vote.classify(docs, labels, keep=["doc_id", *ODD]), quality_rules.judged(docs, keep=["doc_id", *ODD]),
    ):
        assert kept(out)
    assert packing.pack(docs).count() >= docs.count() and ngram_join.join_components(docs).count() == docs.count()
    assert pii.detect(docs, keep=["doc_id", *ODD]).select(*ODD).count() == docs.count()


def test_stages_keep_columns_of_any_name(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and kept(out)


def test_salts_are_those_of_the_row(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(i if i % 9 else None, "the same text") for i in range(60)] + [(100, None)], "doc_id long, text string")
    counts = [sorted(map(str, token_counts.count_tokens(rows.repartition(n)).collect())) for n in (1, 7)]
    assert counts[0] == counts[1] and len(counts[0]) == 61
    assert "rand(" not in token_counts.count_tokens(rows)._jdf.queryExecution().toString()


def test_counts_come_from_the_cache(spark):
    """A second run on one cache encodes nothing: what the cache says is what it gives."""
    cache = written(spark.range(1), "cache").inputFiles()[0].rpartition("/")[0] + "-counts"
    rows = spark.createDataFrame([(1, "some words"), (2, "other words"), (3, "some words")], "doc_id long, text string")
    first = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(rows, cache=cache).collect()}
    stored = token_counts.open_cache(spark, cache)
    assert stored.count() == 2
    marked = cache + "-marked"
    stored.withColumn("n_tokens", F.col("n_tokens") + 1000).write.parquet(marked)
    more = rows.union(spark.createDataFrame([(4, "a third text")], rows.schema))
    again = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(more, cache=marked).collect()}
    assert all(again[i] == first[i] + 1000 for i in (1, 2, 3)) and 0 < again[4] < 1000
    assert token_counts.open_cache(spark, marked).count() == 3


def test_licence_digests_are_those_of_the_query(spark):
    own = {(r.d, r.license_id) for r in licenses.known_licenses(spark).groupBy(licenses.canonical_digest(F.col("text")).alias("d")).agg(F.min("license_id").alias("license_id")).collect()}
    assert own == set(licenses.known_digests())


def test_planted_licences_match_in_sql_too(spark, tmp_path):
    apache = next(t for n, t in licenses.variants() if n == "Apache-2.0")
    rows = [(1, apache.upper()), (2, "Copyright (c) 2020 Jane Doe\n\n" + licenses.KNOWN["MIT"]), (3, "no licence"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.canonical_sha256, r.license_id, r.is_license) for r in registry.QUERIES["op5_license_scan"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == {tuple(None if x != x else x for x in r) for r in c.execute(registry.ORACLES["op5_license_scan"]).fetchall()}
    assert {(r[0], r[2]) for r in got} == {(1, "Apache-2.0"), (2, "MIT"), (3, None), (4, None)}
