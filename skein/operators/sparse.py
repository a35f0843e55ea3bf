"""Exact pairs of sparse vectors by an inverted index with prefix bounds.

Coordinates have one global order, the most frequent first. Of each vector the longest beginning whose norm can't reach the cut
alone isn't indexed: two vectors whose dot product reaches the cut share one of the coordinates that both have in the index
(were there none, the dot product would be at most the norm of the later ending beginning times the largest norm). So rare
coordinates make the candidates, and a vector is copied once for each coordinate that it has in the index, not once for each
block of its group. The vectors of one coordinate meet in blocks, where the dot products are summed over shared coordinates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.core import join_checked, prepare, written

#: Vectors of one coordinate that meet in a block, about, and coordinates that are taken at once.
BLOCK, SLICE = 1024, 1024


def sparse_entries(vector) -> F.Column:
    """A dense vector's entries other than zero, as array<struct<i, w>>."""
    pairs = F.transform(vector, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("w")))
    return F.filter(pairs, lambda e: e["w"] != 0)


def indexed(rows: DataFrame, at_least: float) -> DataFrame:
    """(grp, id, fresh, at, coordinate, is, ws): each vector once for each coordinate that it has in the index, with all its entries in the global order; at is that coordinate's place there.

    rows: (grp, id, fresh, e) with e as sparse_entries gives; a group's ids are distinct.
    """
    entries = rows.select("grp", "id", "fresh", F.explode("e").alias("e")).select("grp", "id", "fresh", "e.i", "e.w")
    often = written(entries.groupBy(F.col("i").alias("of")).agg(F.count(F.lit(1)).alias("n")), "coordinates")
    placed = join_checked(entries, often, F.col("i") == F.col("of"))
    whole = placed.groupBy("grp", "id", "fresh").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "i", "w"))).alias("e"))
    whole = written(whole.withColumn("norm", F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))), "vectors")
    most = whole.agg(F.max("norm")).first()[0] or 1.0
    limit = (at_least * (1 - 1e-9) / most) ** 2
    none = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    short = F.aggregate("e", none, lambda a, x: F.struct((a["s"] + x["w"] * x["w"]).alias("s"), (a["n"] + (a["s"] + x["w"] * x["w"] < limit).cast("int")).alias("n")))["n"]
    parts = whole.select("grp", "id", "fresh", F.transform("e", lambda x: x["i"]).alias("is"), F.transform("e", lambda x: x["w"]).alias("ws"), short.alias("short"))
    parts = parts.where(F.col("short") < F.size("is")).withColumn("at", F.explode(F.sequence("short", F.size("is") - 1)))
    return parts.select("grp", "id", "fresh", "at", F.get("is", F.col("at")).alias("coordinate"), "is", "ws")


def _side(t: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, coordinate, weight, whether it comes after the posting's own) of the entries of some rows."""
    t = t.take(pa.array(rows))
    lists = t["is"].combine_chunks()
    count = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(rows)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, lists.flatten().to_numpy(), t["ws"].combine_chunks().flatten().to_numpy(zero_copy_only=False), place > t["at"].to_numpy()[row]


def _products(x, y, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(dot products, how many coordinates after the posting's own are shared) of the rows of two sides."""
    shared = np.intersect1d(x[1], y[1])
    dots, later = np.zeros(shape), np.zeros(shape, np.float32)
    for k in range(0, len(shared), SLICE):
        some = shared[k : k + SLICE]
        dense, after = [], []
        for (row, coordinate, weight, behind), n in ((x, shape[0]), (y, shape[1])):
            at = np.searchsorted(some, coordinate)
            own = (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == coordinate)
            m, late = np.zeros((n, len(some))), np.zeros((n, len(some)), np.float32)
            m[row[own], at[own]] = weight[own]
            late[row[own & behind], at[own & behind]] = 1
            dense.append(m)
            after.append(late)
        dots += dense[0] @ dense[1].T
        later += after[0] @ after[1].T
    return dots, later


def _met(posted: DataFrame, fresh: bool) -> DataFrame:
    """The postings in the blocks (x, y) where they meet. left and right: the sides that a row is on there; once: whether a pair of the block is also met the other way round."""
    kept = ["grp", "coordinate", "id", "at", "is", "ws"]
    sizes = posted.groupBy(F.col("grp").alias("g"), F.col("coordinate").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.count_if("fresh").alias("m")).where("n > 1 and m > 0")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = written(sizes.select("g", "c", blocks("n").alias("blocks"), blocks("m").alias("fresh_blocks")), "sizes")
    dealt = join_checked(posted, sizes, F.col("grp").eqNullSafe(F.col("g")) & (F.col("coordinate") == F.col("c")))
    at = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    if not fresh:
        own = at("blocks")
        others = F.transform(upto("blocks"), lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y")))
        met = dealt.select(*kept, own.alias("own"), F.explode(others).alias("o")).select(*kept, "own", "o.x", "o.y")
        own = F.col("own")
        return met.select(*kept, "x", "y", (own == F.col("x")).alias("left"), (own == F.col("y")).alias("right"), (F.col("x") == F.col("y")).alias("once"))
    left = dealt.where("fresh").select(*kept, at("fresh_blocks").alias("x"), F.explode(upto("blocks")).alias("y"), F.lit(True).alias("left"), F.lit(False).alias("right"), F.lit(True).alias("once"))
    right = dealt.select(*kept, F.explode(upto("fresh_blocks")).alias("x"), at("blocks").alias("y"), F.lit(False).alias("left"), F.lit(True).alias("right"), F.col("fresh").alias("once"))
    return left.unionByName(right)


def sparse_pairs(rows: DataFrame, at_least: float, id_col: str = "id", group_col: str = "kind", entries: str = "entries", possible: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None, fresh: str | None = None) -> DataFrame:
    """(group, a, b, cosine, coordinate) with a < b for vectors of one group (null: a group of its own) whose dot product reaches the cut, which is above 0.

    entries: array<struct<i, w>>, each coordinate once. A pair comes from the last coordinate that both have in the index, so it
    is found once. With `possible`, only pairs that a later test may pass leave their task: of the ids of a block's two sides it
    gives the places (p, q) of those pairs. With `fresh`, a boolean column, only pairs with a fresh row: fresh rows meet all others, which don't meet each other.
    """
    if at_least <= 0:
        raise ValueError("the cut must be above 0")
    prepare(rows.sparkSession)
    rows = rows.select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), F.col(entries).alias("e"), (F.lit(True) if fresh is None else F.col(fresh)).alias("fresh")).where("e is not null")
    met = _met(written(indexed(rows, at_least), "postings"), fresh is not None)
    kind, own = rows.schema["id"].dataType.simpleString(), rows.schema["grp"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        ids, once = np.array(t["id"].to_pylist(), dtype=object), t["once"].to_numpy()
        x, y = np.flatnonzero(t["left"].to_numpy()), np.flatnonzero(t["right"].to_numpy())
        dots, later = _products(_side(t, x), _side(t, y), (len(x), len(y)))
        p, q = np.nonzero((dots >= at_least) & (later == 0)) if possible is None else possible(ids[x], ids[y])
        keep = (dots[p, q] >= at_least) & (later[p, q] == 0)
        p, q = p[keep], q[keep]
        a, b = ids[x[p]], ids[y[q]]
        keep = ((a < b) | ~once[y[q]] & (a != b)).astype(bool)
        a, b, cosine = a[keep], b[keep], dots[p, q][keep]
        swap = (a > b).astype(bool)
        low, high = np.where(swap, b, a), np.where(swap, a, b)
        grp = pa.array([t["grp"][0].as_py()] * len(low), t.schema.field("grp").type)
        return pa.table({"grp": grp, "a": pa.array(low.tolist(), t.schema.field("id").type), "b": pa.array(high.tolist(), t.schema.field("id").type), "cosine": pa.array(cosine), "coordinate": pa.array(np.full(len(low), t["coordinate"][0].as_py()), pa.int32())})

    # few bytes, but much work a block: a stated number of tasks is not merged
    met = met.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, "grp", "coordinate", "x", "y")
    out = met.groupBy("grp", "coordinate", "x", "y").applyInArrow(run, f"grp {own}, a {kind}, b {kind}, cosine double, coordinate int")
    return out.withColumnRenamed("grp", group_col)
