"""Connected components of an edge table by hooking and contraction: each round's edges are those between the last one's trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


def _roots(edges: DataFrame, tasks: int | None) -> DataFrame:
    """(node, comp): each node hooks to its smallest neighbour, if that is smaller, and then to the end of that chain."""
    both = edges.select(F.col("a").alias("node"), "b").union(edges.select(F.col("b").alias("node"), "a"))
    hooks = written(both.groupBy("node").agg(F.min(F.least("node", "b")).alias("comp")), "hooks", tasks)
    while True:
        up = hooks.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        hooks = written(hooks.join(up, F.col("comp") == F.col("mid")).select("node", F.col("far").alias("comp"), (F.col("far") < F.col("comp")).alias("moved")), "hooks", tasks)
        if hooks.where("moved").limit(1).count() == 0:
            return hooks.select("node", "comp")
        hooks = hooks.select("node", "comp")


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(node, comp) for each node of edges (a, b): comp is the smallest node of its component.

    tasks: at most so many files a table. Chains only lead to smaller nodes, so a root is the smallest of its tree; the trees that edges join go into the next round.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges", tasks)
    labels = None
    while True:
        roots = _roots(edges, tasks)
        if labels is None:
            labels = roots
        else:
            step = roots.select(F.col("node").alias("old"), F.col("comp").alias("new"))
            labels = written(labels.join(step, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp")), "labels", tasks)
        x, y = (roots.select(F.col("node").alias(f"node_{c}"), F.col("comp").alias(f"comp_{c}")) for c in "ab")
        between = edges.join(x, F.col("a") == F.col("node_a")).join(y, F.col("b") == F.col("node_b")).where("comp_a <> comp_b")
        edges = written(between.select(F.least("comp_a", "comp_b").alias("a"), F.greatest("comp_a", "comp_b").alias("b")).distinct(), "edges", tasks)
        if edges.limit(1).count() == 0:
            return labels
