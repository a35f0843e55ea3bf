"""Places in an order, and each row's next row, where a group may be the whole table.

A window gathers all rows of a group in one task. Here rows are dealt by range of (group, order), so that a group spreads over
neighbouring tasks; each task numbers its own rows, and what crosses an edge between two tasks is stitched from their first
and last rows, one of each a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.core import join_checked, prepare, task_count, written


def fresh(columns: list[str], *stems: str) -> list[str]:
    """Names that begin like the stems and that no column has (names are compared without case)."""
    used, out = {c.lower() for c in columns}, []
    for s in stems:
        while s.lower() in used:
            s += "_"
        used.add(s.lower())
        out.append(s)
    return out


def _differs(column: pa.Array) -> pa.Array:
    """Whether each value but the first differs from the one before it; nulls are equal."""
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    return pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.not_equal(pc.is_null(now), pc.is_null(before)))


def _numbered(group: list[str], nexts: dict[str, str]):
    """Batches of one task, in order, with pos (within the group, in this task), head (still the task's first group), last (its last row) and the next row's values within the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, count, head = None, None, 0, True

        def out(b: pa.RecordBatch, pos: np.ndarray, heads: np.ndarray, follower: pa.RecordBatch | None, same: bool) -> pa.RecordBatch:
            n, columns, names = len(b), list(b.columns), list(b.schema.names)
            starts = pa.array(np.append(pos[1:] == 1, not same))  # the row after each begins another group
            for name, of in nexts.items():
                column = b.column(of)
                after = follower.column(of).slice(0, 1) if follower is not None else pa.nulls(1, column.type)
                moved = pa.concat_arrays([column.slice(1), after])
                columns.append(pc.if_else(starts, pa.nulls(n, column.type), moved))
                names.append(name)
            last = np.zeros(n, bool)
            last[-1] = follower is None
            columns += [pa.array(pos), pa.array(heads), pa.array(last)]
            return pa.RecordBatch.from_arrays(columns, names=[*names, "pos", "head", "last"])

        for b in batches:
            if not len(b):
                continue
            breaks, at = np.zeros(len(b), bool), np.arange(len(b))
            for g in group:
                if len(b) > 1:
                    breaks[1:] |= _differs(b.column(g)).to_numpy(zero_copy_only=False)
            first = [b.column(g)[0].as_py() for g in group]
            breaks[0] = key is not None and first != key
            begun = np.maximum.accumulate(np.where(breaks, at, -1))  # where each row's group begins, -1: before this batch
            pos, heads = np.where(begun < 0, count + at + 1, at - begun + 1).astype(np.int64), (begun < 0) & head
            count, head = int(pos[-1]), bool(heads[-1])
            if held is not None:
                yield out(*held, b, not breaks[0])
            held, key = (b, pos, heads), [b.column(g)[len(b) - 1].as_py() for g in group]
        if held is not None:
            yield out(*held, None, False)

    return run


def _stitched(first: list[dict], last: list[dict], group: list[str], nexts: dict[str, str]) -> list[dict]:
    """For each task with rows: how many rows of its first group earlier tasks hold, and what follows its last row."""
    first, last = (sorted(x, key=lambda r: r["part"]) for x in (first, last))
    out, before, total = [], None, 0
    for k, (f, e) in enumerate(zip(first, last, strict=True)):
        offset = total if before is not None and [f[g] for g in group] == before else 0
        before, total = [e[g] for g in group], e["pos"] + (offset if e["head"] else 0)
        after = first[k + 1] if k + 1 < len(first) and [first[k + 1][g] for g in group] == before else None
        out.append({"part": f["part"], "offset": offset} | {name: None if after is None else after[of] for name, of in nexts.items()})
    return out


def in_order(df: DataFrame, group: list[str], order: list[Column | str], rank: str | None = "rank", nexts: dict[str, str] | None = None, tasks: int | None = None) -> DataFrame:
    """df with the 1-based place of each row in the order of its group (as rank), and with nexts (new name: column) what the next row of the group has there, null after the last.

    Nulls are a group of their own; order should tell all rows of a group apart, else equals fall in any order. group takes
    columns of plain types but no floating point, and none that order a group means the whole table. Rows are shuffled once,
    by range, and written; only the rows at the edges of tasks, two a task, are read by the driver.
    """
    spark, nexts = df.sparkSession, nexts or {}
    prepare(spark)
    names = df.columns
    inner = {n: f"n{i}" for i, n in enumerate(nexts)}
    plain = {c: f"c{i}" for i, c in enumerate(names)}
    keys = [F.col(g).asc_nulls_first() for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = df.repartitionByRange(tasks or task_count(df), *keys).sortWithinPartitions(*keys)
    dealt = dealt.select(*[F.col(f"`{c}`").alias(plain[c]) for c in names], F.spark_partition_id().alias("part"))
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    own, follow = [plain[g] for g in group], {inner[n]: plain[of] for n, of in nexts.items()}
    shape = ", ".join([*[f"{c} {k}" for c, k in kinds.items()], *[f"{n} {kinds[of]}" for n, of in follow.items()], "pos long, head boolean, last boolean"])
    placed = written(dealt.mapInArrow(_numbered(own, follow), shape), "ordered")
    wanted = ["part", "pos", "head", *dict.fromkeys([*own, *follow.values()])]
    ends = placed.where("last or (head and pos = 1)").select("last", *wanted).toArrow().to_pylist()
    rows = _stitched([r for r in ends if r["head"] and r["pos"] == 1], [r for r in ends if r["last"]], own, follow)
    schema = ", ".join(["part int, offset long", *[f"{n} {kinds[of]}" for n, of in follow.items()]])
    edges = spark.createDataFrame([tuple(r.values()) for r in rows], schema).coalesce(1).select(F.col("part").alias("edge"), "offset", *[F.col(n).alias(f"e{n}") for n in follow])
    both = join_checked(placed, edges, F.col("part") == F.col("edge"), "left")
    out = [F.col(plain[c]).alias(c) for c in names]
    if rank is not None:
        out.append((F.col("pos") + F.when(F.col("head"), F.col("offset")).otherwise(0)).alias(rank))
    out += [F.when(F.col("last"), F.col(f"e{inner[n]}")).otherwise(F.col(inner[n])).alias(n) for n in nexts]
    return both.select(*out)
