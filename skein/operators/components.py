"""Connected components of an edge table by smallest labels, with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.core import prepare, written

#: Nodes that a task of `contracted` holds before it hands on what it has found.
HELD = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def stars() -> pa.RecordBatch:
        found = [(x, root(x)) for x in list(parent) if parent[x] != x]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        kind = batch.schema.field("a").type
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            p, q = root(x), root(y)
            parent[max(p, q)] = min(p, q)
        if len(parent) > HELD:
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def contracted(edges: DataFrame, by: str) -> DataFrame:
    """(a, b): fewer edges with the components of edges (a, b), as stars of what tasks by another column find.

    The more of a component has one value of that column, the fewer turns are left for connected_components.
    """
    prepare(edges.sparkSession)
    kind = edges.schema["a"].dataType.simpleString()
    return edges.repartition(by).select("a", "b").mapInArrow(_forest, f"a {kind}, b {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node that edges reach. Minima combine before each shuffle."""
    edges = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = written(edges.union(edges.select("y", "x")).distinct(), "edges")
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("x"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("mid"))
        step = written(step, "step")
        far = step.select(F.col("node").alias("root"), F.col("mid").alias("far"))
        step = written(step.join(far, F.col("mid") == F.col("root"), "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("old <> component").limit(1).count() == 0:
            return labels
