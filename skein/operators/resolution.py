"""Canonical entities kept up to date: what mentions have come or gone decides which names, links and clusters are made anew.

Beside the entities a snapshot keeps what they were made of: the normalised mentions, the vector of each name, the links between
names and the labels of their components. A change of mentions makes the vectors of the names that it touches anew, joins those
with all vectors, and hooks the new links into the stored labels: components that a changed name or a new link touches are taken
apart and put together again from the links among their names; all others, with their entities and owners, stay as they are. The
result is that of making everything anew, as no link crosses from a touched component to one that isn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.core import join_checked, prepare, written
from skein.sources.snapshots import Change

from . import entities
from .components import connected_components

NAMED, VECTORS, LINKS, LABELS = "named_mentions", "name_vectors", "name_links", "name_labels"


def _without(df: DataFrame, side: DataFrame, on: str, key: str) -> DataFrame:
    """df without the rows whose `on` is among the keys, and the other way round with _with."""
    return join_checked(df, side.select(F.col(key).alias("gone")), F.col(on) == F.col("gone"), "left_anti")


def _with(df: DataFrame, side: DataFrame, on: str, key: str) -> DataFrame:
    return join_checked(df, side.select(F.col(key).alias("had")), F.col(on) == F.col("had"), "left_semi")


def rebuild(change: Change, found: DataFrame, cosine: float = 0.90, name_cut: float = 0.72, floor: float = 0.90, dim: int = 256) -> dict[str, int]:
    """Makes entities, support and the tables beneath them of all mention records anew. Gives the numbers of names and clusters."""
    prepare(found.sparkSession)
    m = written(entities.normalised(found), "mentions")
    vectors = written(entities.name_vectors(m, dim), "clusters")
    links = written(entities.name_links(vectors, max(cosine, floor), name_cut).select("a", "b"), "links")
    labels = written(connected_components(links), "labels")
    nodes, owners = entities.canonical(m, labels, dim)
    for name, df in ((NAMED, m), (VECTORS, vectors), (LINKS, links), (LABELS, labels), ("entities", nodes), ("support", owners)):
        change.replace(name, df)
    n = nodes.count()
    return {"changed": vectors.count(), "rebuilt": n, "clusters": n}


def update(change: Change, found: DataFrame, cosine: float = 0.90, name_cut: float = 0.72, floor: float = 0.90, dim: int = 256) -> dict[str, int]:
    """The tables of `rebuild` for new mention records, made anew only where they differ from the stored ones.

    Gives how many names changed, how many clusters were made and how many there are.
    """
    if not change.has(NAMED):
        return rebuild(change, found, cosine, name_cut, floor, dim)
    prepare(found.sparkSession)
    m, stored = written(entities.normalised(found), "mentions"), change.read(NAMED).select(*found.columns)
    name = F.col("normalized_name").alias("cluster")
    changed = written(m.subtract(stored).select(name).union(stored.subtract(m).select(name)).distinct(), "changed")
    if not changed.limit(1).count():
        return {"changed": 0, "rebuilt": 0, "clusters": change.read("entities").count()}
    fresh = written(entities.name_vectors(_with(m, changed, "normalized_name", "cluster"), dim), "fresh")
    vectors = written(_without(change.read(VECTORS), changed, "cluster", "cluster").unionByName(fresh), "clusters")
    made = written(entities.name_links(vectors, max(cosine, floor), name_cut, changed).select("a", "b"), "made")
    links = written(_without(_without(change.read(LINKS), changed, "a", "cluster"), changed, "b", "cluster").unionByName(made), "links")
    labels = change.read(LABELS)
    touched = written(changed.union(made.select("a")).union(made.select("b")).distinct(), "touched")
    known = touched.join(labels, F.col("cluster") == F.col("node"), "left")
    torn = written(known.select(F.coalesce("component", "cluster").alias("component")).distinct(), "torn")
    names = written(_with(labels, torn, "component", "component").select(F.col("node").alias("cluster")).union(touched).distinct(), "names")
    joined = written(connected_components(_with(links, names, "a", "cluster")), "joined")
    nodes, owners = entities.canonical(written(_with(m, names, "normalized_name", "cluster"), "mentions"), joined, dim)
    made_new = nodes.count()
    for table, new, key in (("entities", nodes, "cluster"), ("support", owners, "cluster")):
        change.replace(table, _without(change.read(table), torn, key, "component").unionByName(new))
    change.replace(LABELS, _without(labels, names, "node", "cluster").unionByName(joined))
    for table, df in ((NAMED, m), (VECTORS, vectors), (LINKS, links)):
        change.replace(table, df)
    return {"changed": changed.count(), "rebuilt": made_new, "clusters": change.read("entities").count()}
