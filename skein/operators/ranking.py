"""All rows in their order for each query, where the result is the product of both and so can be neither shuffled nor written.

A task has some queries and reads all vectors, a batch at a time, from the shared folder; it keeps their scores alone, as many as
are bounded, and numbers them. Where a query has more rows than that, several tasks share it by ranges of its order: each counts
what comes before its range and keeps what lies within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.core import prepare, written

#: Scores that a task holds, about (128 MB); bytes of vectors in a row of the packed table; rows that tell where ranges begin, for each range.
HELD, PACK, SAMPLE = 16 << 20, 64 << 10, 256
#: Rows of a batch of the result.
OUT = 1 << 16


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _pack(kind: str):
    """Batches (id, v) as rows (ids, vs) of some vectors each, without those that are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column("v").is_valid())
            if not len(b):
                continue
            v = _flat(b.column("v"), kind)
            each = max(1, PACK // max(1, v.shape[1] * v.itemsize))
            at = np.append(np.arange(0, len(b), each), len(b))
            vs = pa.array([v[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at.astype(np.int32), b.column("id")), vs], names=["ids", "vs"])

    return run


def _before(scores: np.ndarray, ids: np.ndarray, edge: tuple) -> np.ndarray:
    return (scores > edge[0]) | ((scores == edge[0]) & (ids < edge[1]))


class _Ranks:
    """The order of the rows of one range for some queries."""

    def __init__(self, asked: pa.Array, kind: str, part: int, parts: int, sample: tuple | None):
        self.ids, self.q = asked.field("q"), _flat(asked.field("v"), kind).astype(float)
        self.edges = []
        for q in self.q if parts > 1 else ():
            scores = np.round(q @ sample[1].astype(float).T, 9)
            order = np.lexsort((sample[0], -scores))
            edge = lambda p, s=scores, o=order: None if p in (0, parts) else (s[o[p * len(o) // parts]], sample[0][o[p * len(o) // parts]])
            self.edges.append((edge(part), edge(part + 1)))
        self.offset, self.held = [0] * len(self.q), []

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        scores = np.round(self.q @ v.astype(float).T, 9)
        if not self.edges:
            self.held.append((ids, scores))
            return
        some = []
        for k, (first, last) in enumerate(self.edges):
            early = np.zeros(len(ids), bool) if first is None else _before(scores[k], ids, first)
            own = ~early if last is None else ~early & _before(scores[k], ids, last)
            self.offset[k] += int(early.sum())
            some.append((ids[own], scores[k][own]))
        self.held.append(some)

    def out(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        whole = not self.edges
        if whole:
            ids = np.concatenate([h[0] for h in self.held])
            by_id = np.argsort(ids, kind="stable")
            ids = ids[by_id]
        for k in range(len(self.q)):
            if not whole:
                ids = np.concatenate([h[k][0] for h in self.held])
                by_id = np.argsort(ids, kind="stable")
                ids = ids[by_id]
            scores = np.concatenate([h[1][k] if whole else h[k][1] for h in self.held])[by_id]
            found = ids[np.argsort(-scores, kind="stable")]
            for low in range(0, len(found), OUT):
                n = min(OUT, len(found) - low)
                rank = np.arange(low + 1, low + n + 1) + self.offset[k]
                yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(np.full(n, k))), pa.array(found[low : low + n], kind), pa.array(rank)], names=["q", "id", "rank"])


def full_ranking(rows: DataFrame, queries: DataFrame, id_col: str = "id", vector_col: str = "embedding", query_col: str = "query_id") -> DataFrame:
    """(query_id, id, rank): the place of each row in the order of its dot product (to nine digits) with each query, the largest first, ties by id.

    rows: (id, vector); queries: (query_id, vector); ids are distinct, null vectors are left out. Written are the vectors, once.
    """
    spark = rows.sparkSession
    prepare(spark)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, query_col), (rows, id_col))]
    kind = "<f4" if isinstance(rows.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    asked_kind = "<f4" if isinstance(queries.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    packed = written(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(_pack(kind), f"ids array<{kinds[1]}>, vs binary"), "packed")
    asked = written(queries.select(F.col(query_col).alias("q"), F.col(vector_col).alias("v")).where("v is not null"), "asked")
    n, m = packed.agg(F.sum(F.size("ids"))).first()[0] or 0, asked.count()
    parts = 1 if n <= HELD else -(-2 * n // HELD)
    tasks = max(1, min(m, max(2 * spark.sparkContext.defaultParallelism, -(-m * (n // parts) * 5 // (4 * HELD)))))
    sample = None
    if parts > 1:
        drawn = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).orderBy(F.xxhash64("id")).limit(SAMPLE * parts).toArrow()
        sample = drawn["id"].to_numpy(), _flat(drawn["v"].combine_chunks(), kind)
    dealt = asked.groupBy(F.pmod(F.xxhash64("q"), F.lit(tasks)).cast("int").alias("block")).agg(F.collect_list(F.struct("q", "v")).alias("asked"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("task", F.col("block") * parts + F.col("part"))
    dealt = dealt.repartitionById(tasks * parts, "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, _Ranks] = {}
        for b in batches:
            task, lists, width = b.column("task").to_numpy(), b.column("ids"), None
            ids_kind = lists.type.value_type
            for t in np.unique(task).tolist():
                own = np.flatnonzero(task == t)
                if t not in open_:
                    open_[t] = _Ranks(b.column("asked").slice(own[0], 1).flatten(), asked_kind, t % parts, parts, sample)
                width = open_[t].q.shape[1]
                some = b.take(pa.array(own))
                v = np.frombuffer(b"".join(some.column("vs").to_pylist()), kind).reshape(-1, width)
                open_[t].add(some.column("ids").flatten().to_numpy(zero_copy_only=False), v)
        for ranks in open_.values():
            yield from ranks.out(ids_kind)

    # One partition of vectors, which each task streams; the other side has one row a partition.
    met = packed.coalesce(1).hint("shuffle_replicate_nl").crossJoin(dealt.select("task", "asked"))
    return met.mapInArrow(run, f"q {kinds[0]}, id {kinds[1]}, rank long").withColumnsRenamed({"q": query_col, "id": id_col})
