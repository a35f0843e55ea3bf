"""Merkle manifest of a table in Pregel-style supersteps over RDDs.

Each row is a leaf, each lang a tree of its own, and the trees' roots are the leaves of a last tree. A vertex is a block of 2 ** LEVELS
neighbouring nodes, so that most messages stay within it: in a superstep upward a block hashes its nodes level by level and messages
its top to its parent block, which hashes on when it has heard all its children. In a superstep downward a block that knows the path
from its top to the root messages each child block the sibling digests of its own way, until the leaves' blocks have every leaf's
proof. No message gathers more than a block, and a lang with most of the rows is only a tree with more blocks (three supersteps for
ten billion leaves). Every superstep's blocks are kept as a file set in the shared folder, which is the manifest, and which ends the
lineage.

H is SHA-256 of the inputs, digests as their lowercase hex text. Leaves ascend by doc_id, null first, and rows that share one by
their digest; langs ascend by their UTF-8 bytes, null first. Defined cases: null columns count as `-` and empty texts as `0:`;
repeated rows are leaves each; an empty table has no leaf and no result; further columns don't enter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.ordering import in_order

from ._shared import bounded_batches, join_checked, task_count, work_path, written

#: Levels of a block, and nodes that a task of a superstep handles, about.
LEVELS, NODES = 12, 50_000
#: The last tree's number among the trees.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Key = tuple[int, int]  # (tree, place among the blocks of its superstep)
Block = tuple[Key, tuple[int, list[tuple]]]  # with the size of its lowest level, and that level's nodes in order: digest first


def digest(parts: Iterable[bytes]) -> bytes:
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def leaf_digest(n_chars: Column | None = None) -> Column:
    """H of a row's fields, each with its length in bytes before it."""

    def said(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.unhex(F.sha2(F.concat(*[said(n_chars if c == "n_chars" and n_chars is not None else F.col(c)) for c in FIELDS]), 256))


def _saved(nodes: RDD, folder: str, name: str, tasks: int) -> RDD:
    """The RDD as at most so many files in the shared folder, and read again from there."""
    nodes.coalesce(tasks).saveAsPickleFile(f"{folder}/{name}")
    return nodes.context.pickleFile(f"{folder}/{name}")


def _tasks(nodes: int) -> int:
    return max(2, -(-nodes // NODES))


def blocks(nodes: RDD, levels: int, tasks: int) -> RDD:
    """Nodes ((tree, pos), (size of their level, node)) gathered by block, each in order of pos."""

    def gathered(heard) -> tuple[int, list[tuple]]:
        own = sorted(heard, key=lambda x: x[0])
        return own[0][1], [node for _, _, node in own]

    return nodes.map(lambda x: ((x[0][0], x[0][1] >> levels), (x[0][1], *x[1]))).groupByKey(tasks).mapValues(gathered)


def rise(size: int, nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The levels of a block from the lowest on. size: of the whole level; where it is 1 the tree ends."""
    out = [nodes]
    while size > 1 and len(out) <= levels:
        low, size = out[-1], (size + 1) // 2
        out.append([digest(low[i : i + 2]) for i in range(0, len(low), 2)])
    return out


def height(size: int) -> int:
    return (size - 1).bit_length()


def way(levels: list[list[bytes]], place: int) -> bytes:
    """From a node of a block's lowest level to its top: a side (0 for none) and the sibling's digest for each level."""
    out = []
    for level in levels[:-1]:
        other = place ^ 1
        out.append(b"\0" if other >= len(level) else (b"\1" if place & 1 else b"\2") + level[other])
        place >>= 1
    return b"".join(out)


def steps(path: bytes) -> list[tuple[int, bytes]]:
    """(0, none), (1, the sibling to the left) or (2, the one to the right), from the leaf to the root."""
    out, i = [], 0
    while i < len(path):
        side = path[i]
        out.append((side, path[i + 1 : i + 33] if side else b""))
        i += 33 if side else 1
    return out


def fold(leaf: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, sibling in path:
        leaf = digest((leaf,) if side == 0 else (sibling, leaf) if side == 1 else (leaf, sibling))
    return leaf


@dataclass(frozen=True)
class Manifest:
    """folder holds the blocks of each superstep; trees is (tree, lang, subroot), one row a lang; sizes are the nodes that enter each superstep, of the langs' trees and of the last one."""

    folder: str
    root: bytes | None
    trees: DataFrame
    sizes: list[int]
    top_sizes: list[int]
    levels: int


def _sizes(nodes: int, trees: int, longest: int, levels: int) -> list[int]:
    """About how many nodes enter each superstep, until the largest tree is one block."""
    out = [nodes]
    while (longest := -(-longest >> levels)) > 1:
        out.append(min((out[-1] >> levels) + trees, out[-1]))
    return out


def _grown(nodes: RDD, folder: str, name: str, sizes: list[int], levels: int) -> RDD:
    """Supersteps upward. The roots: (tree, (the superstep in which it ended, its digest))."""
    roots = []
    for k, n in enumerate(sizes):
        held = _saved(blocks(nodes, levels, _tasks(n)), folder, f"{name}-{k}", _tasks(n))
        tops = held.map(lambda x: (x[0], (height(x[1][0]), x[1][0], rise(x[1][0], [node[0] for node in x[1][1]], levels)[-1][0])))
        roots.append(tops.filter(lambda x: x[1][0] <= levels).map(lambda x, k=k: (x[0][0], (k, x[1][2]))))
        nodes = tops.filter(lambda x: x[1][0] > levels).map(lambda x: (x[0], (-(-x[1][1] >> levels), (x[1][2],))))
    return nodes.context.union(roots)


def build(docs: DataFrame, claimed: Column | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of a table, whose lowest blocks hold its leaves. claimed: the n_chars that a copy to be verified has, where it differs (null: it doesn't)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder, tasks = work_path(spark, "merkle"), task_count(docs)
    own = docs.select("doc_id", "lang", leaf_digest().alias("leaf"), (F.lit(None).cast("binary") if claimed is None else F.when(claimed.isNotNull(), leaf_digest(claimed))).alias("claimed"))
    placed = in_order(written(own, "leaves", tasks), ["lang"], [F.col("doc_id").asc_nulls_first(), "leaf"], "pos")
    trees = placed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    trees = written(in_order(trees, [], [F.col("lang").asc_nulls_first()], "tree"), "trees").withColumn("tree", F.col("tree") - 1)
    of = trees.select(F.col("lang").alias("of"), "tree", "n")
    leaves = join_checked(placed, of, F.col("lang").eqNullSafe(F.col("of"))).select("doc_id", "lang", "tree", (F.col("pos") - 1).alias("pos"), "n", "leaf", "claimed")
    leaves = written(leaves, "placed", tasks)
    many, longest, total = trees.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    if not many:
        return Manifest(folder, None, trees.select("tree", "lang", F.lit(None).cast("binary").alias("subroot")), [], [], levels)
    sizes, top = _sizes(total, many, longest, levels), _sizes(many, 1, many, levels)
    nodes = leaves.select("tree", "pos", "n", "leaf", "doc_id", "claimed").rdd.map(lambda r: ((r[0], r[1]), (r[2], (bytes(r[3]), r[4], r[5] and bytes(r[5])))))
    roots = _saved(_grown(nodes, folder, "level", sizes, levels), folder, "roots", _tasks(many))
    root = _grown(roots.map(lambda x: ((TOP, x[0]), (many, (x[1][1],)))), folder, "top", top, levels).first()[1][1]
    table = written(spark.createDataFrame(roots.map(lambda x: (x[0], bytearray(x[1][1]))), "root_of long, subroot binary"), "subroots", tasks)
    named = join_checked(trees, table, F.col("tree") == F.col("root_of")).select("tree", "lang", "subroot")
    return Manifest(folder, root, named, sizes, top, levels)


def _down(m: Manifest, name: str, sizes: list[int], entries: RDD) -> RDD:
    """Supersteps downward, until those of the lowest blocks: (key, (path from its top, (size, nodes))). entries: (tree, (the superstep in which it ended, the path from its root))."""
    sc, levels = entries.context, m.levels
    paths = sc.emptyRDD()

    def message(item) -> Iterator[tuple[Key, bytes]]:
        (tree, block), (path, (size, nodes)) = item
        own = rise(size, [node[0] for node in nodes], levels)
        for i in range(len(nodes)):
            yield (tree, (block << levels) + i), way(own, i) + path

    for k in range(len(sizes) - 1, -1, -1):
        paths = paths.union(entries.filter(lambda x, k=k: x[1][0] == k).map(lambda x: ((x[0], 0), x[1][1])))
        heard = paths.join(sc.pickleFile(f"{m.folder}/{name}-{k}"), _tasks(sizes[k]))
        if k == 0:
            return heard
        paths = _saved(heard.flatMap(message), m.folder, f"paths-{name}-{k}", _tasks(sizes[k]))
    return paths


def verify(manifest: Manifest, docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified) of the leaves: each, as claimed where that differs, is folded with its siblings and held against the root. docs gives the type of doc_id."""
    spark, m, levels = docs.sparkSession, manifest, manifest.levels
    sc, kind = spark.sparkContext, docs.schema["doc_id"].dataType.simpleString()
    if m.root is None:
        return spark.createDataFrame([], f"doc_id {kind}, lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    roots = sc.pickleFile(f"{m.folder}/roots")
    top = _down(m, "top", m.top_sizes, sc.parallelize([(TOP, (len(m.top_sizes) - 1, b""))], 1))

    def from_root(item) -> Iterator[tuple[int, bytes]]:
        (_, block), (path, (size, nodes)) = item
        own = rise(size, [node[0] for node in nodes], levels)
        yield from (((block << levels) + i, way(own, i) + path) for i in range(len(nodes)))

    many = _tasks(m.top_sizes[0])
    entries = _saved(top.flatMap(from_root).join(roots, many).mapValues(lambda x: (x[1][0], x[0])), m.folder, "entries", many)

    def judged(item):
        (tree, _), (path, (size, nodes)) = item
        own = rise(size, [node[0] for node in nodes], levels)
        for i, (leaf, doc_id, claimed) in enumerate(nodes):
            proof = steps(way(own, i) + path)
            yield doc_id, tree, leaf.hex(), digest(s for side, s in proof if side).hex(), fold(claimed or leaf, proof).hex()

    folded = spark.createDataFrame(_down(m, "level", m.sizes, entries).flatMap(judged), f"doc_id {kind}, tree long, leaf string, proof_sha256 string, folded_root string")
    out = written(folded, "verified", max(_tasks(m.sizes[0]), task_count(docs)))
    named = m.trees.select(F.col("tree").alias("own"), "lang", F.lower(F.hex("subroot")).alias("subroot"))
    both = join_checked(out, named, F.col("tree") == F.col("own"))
    root = m.root.hex()
    return both.select("doc_id", "lang", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def tampered() -> Column:
    """n_chars with 1 added where 7 divides the CRC-32 of the decimal doc_id; null where nothing changes."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1)
