"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, merkle, neighbour_vote, ngram_join, packing, pii, quality_rules, token_counts, token_files, turns, url_filter, warc
from ._shared import task_count, work_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _merged(out: DataFrame, source: DataFrame) -> DataFrame:
    """Results are narrow: the small tasks that made them are merged, so that they aren't a file each."""
    return out.coalesce(task_count(source))


def _gathered(out: DataFrame, source: DataFrame) -> DataFrame:
    """The same after tasks that take long, which stay as many as they are."""
    return out.repartition(task_count(source))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _merged(quality_rules.judged(docs, keep=["doc_id"]), docs)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return _gathered(out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), docs)


def op3_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _gathered(neighbour_vote.classify(docs, _table(spark, sf_dir, "labels"), keep=["doc_id"]), docs)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _merged(ngram_join.join_components(docs), docs)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _gathered(licenses.scan(docs).select("doc_id", "canonical_sha256", "license_id", "is_license"), docs)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _gathered(pii.span_digests(pii.detect(docs, keep=["doc_id"], redacts=False)), docs)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _merged(packing.pack(docs, keep_ids=False).drop("ids"), docs)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "warc")
    pages = _table(spark, sf_dir, "pages")
    warc.write_archives(pages, folder)
    out = warc.read_records(warc.read_index(spark, folder), folder, payloads=False)
    return _gathered(out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), pages)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "tokens")
    docs = _table(spark, sf_dir, "documents")
    token_files.write_token_files(docs, folder)
    return _merged(token_files.read_index(spark, folder), docs)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _merged(token_counts.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit"), docs)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = merkle.verify(merkle.build(docs, merkle.tampered()), docs)
    return _merged(out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"), docs)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judged(_table(spark, sf_dir, "pages"), url_filter.trained(spark))
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.reassemble(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_neighbour_vote": op3_neighbour_vote,
    "op4_ngram_join": op4_ngram_join,
    "op5_license_scan": op5_license_scan,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_token_files": op9_token_files,
    "op10_token_counts": op10_token_counts,
    "op11_merkle": op11_merkle,
    "op12_url_filter": op12_url_filter,
    "op13_turns": op13_turns,
}

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"



def _canonical(text: str) -> str:
    t = f"regexp_replace(lower(coalesce({text}, '')), '{licenses.NOTICE.replace(chr(39), chr(39) * 2)}', ' ', 'g')"
    t = f"regexp_replace(' ' || regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ', ' +', ' ', 'g')".replace("\\\\", "\\")
    for a, b in licenses.SPELLINGS:
        t = f"replace({t}, ' {a} ', ' {b} ')"
    return f"trim({t})"


_KNOWN = ", ".join(f"('{d}', '{name}')" for d, name in licenses.known_digests())

ORACLES: dict[str, str] = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bk AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM bk) WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
""",
    "op8_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
""",
    "op4_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS reached FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT doc_id, min(reached) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""",
    "op5_license_scan": f"""
WITH k AS (SELECT * FROM (VALUES {_KNOWN}) AS v(d, license_id)),
c AS (SELECT doc_id, nullif({_canonical("text")}, '') AS t FROM documents)
SELECT doc_id, sha256(t) AS canonical_sha256, license_id, license_id IS NOT NULL AS is_license FROM c LEFT JOIN k ON k.d = sha256(t)
""",
}
