"""The Merkle manifest against a recursive one in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from skein.llm import merkle
from skein.llm import queries as registry

KIND = "doc_id long, source string, lang string, n_chars int, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def tree(nodes):
    """(root, the siblings of each leaf as (side, digest), from the leaf up)."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
        owners = [at[i : i + 2] for i in range(0, len(at), 2)]
        for run, own in zip(runs, owners, strict=True):
            for side, leaves in enumerate(own):
                for i in leaves:
                    paths[i].append((side, run[1 - side] if len(run) == 2 else None))
        nodes, at = [h(*r) for r in runs], [sum(o, []) for o in owners]
    return nodes[0], paths


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *tree([leaf(r) for r in own])))
    root, tops = tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            way = path + top
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf((*r[:3], r[3] + 1, r[4])) if changed else leaf(r)
            for side, s in way:
                folded = h(folded) if s is None else h(s, folded) if side else h(folded, s)
            out.append((r[0], leaf(r), subroot, root, h(*[s for _, s in way if s is not None]), folded, not changed))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def table(n, langs, seed=0):
    r = random.Random(seed)
    return [(i, r.choice(["web", None]), r.choice(langs), r.choice([None, i, 7]), r.choice(["", "é:1-", None, f"text {i}"])) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        table(130, ["en", None, "fr", "Zz", "é", ""]),
        table(33, ["en"]),
        table(64, ["en", "fr"]),
        [(1, "a", "en", 3, "abc")],
        [(7, "a", "en", 3, "x" * 400_000), (7, "a", "en", 3, "abc"), (7, "a", "en", 3, "abc"), (None, None, None, None, None), (None, None, None, None, None)],
    ],
)
@pytest.mark.parametrize("levels", [3, 12])
def test_every_leaf_has_its_proof(spark, rows, levels):
    docs = spark.createDataFrame(rows, KIND).withColumn("tree", F.lit(1)).withColumn("pos", F.lit("x")).repartition(5)
    assert got(merkle.verify(merkle.build(docs, merkle.tampered(), levels), docs)) == expected(rows)


def test_nothing_claimed_and_no_rows(spark):
    docs = spark.createDataFrame(table(40, ["en", "fr"]), KIND)
    manifest = merkle.build(docs)
    assert merkle.verify(manifest, docs).where("not verified").count() == 0
    assert merkle.verify(merkle.build(docs.limit(0)), docs).count() == 0
    changed = merkle.build(docs.withColumn("text", F.when(F.col("doc_id") == 5, "y").otherwise(F.col("text"))))
    assert changed.root != manifest.root
    again = merkle.build(docs.repartition(7))
    assert again.root == manifest.root


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got(registry.QUERIES["op11_merkle"](spark, sf)) == expected(rows)
