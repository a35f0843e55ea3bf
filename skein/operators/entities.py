"""Canonical entities: exact-name clusters of mentions, merged where type, name and description vectors agree."""

from __future__ import annotations

import collections
import functools
import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.core import is_small, join_checked, prepare, written
from skein.functions import scope
from skein.functions import text as X
from skein.functions.providers import hashed_embedder, hashed_entries
from skein.functions.vectors import hashed_weights

from .components import connected_components, contracted
from .sparse import sparse_entries, sparse_pairs

#: White space as the JVM's expressions split names at.
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def mode_by(rows: DataFrame, group: str, value: str, ties: list[Column], name: str, count: Column | None = None) -> DataFrame:
    """(group, name): the most frequent value (rows count one each, or what count sums up); ties by the given columns."""
    counts = rows.groupBy(group, value).agg((F.count(F.lit(1)) if count is None else count).alias("__n"))
    first = Window.partitionBy(group).orderBy(F.col("__n").desc(), *ties)
    return counts.withColumn("__r", F.row_number().over(first)).where("__r = 1").select(group, F.col(value).alias(name))


def first_appearances(rows: DataFrame, group: str, value: str, order: list[str], name: str) -> DataFrame:
    """(group, name): the distinct values in the order in which they first appear."""
    first = rows.groupBy(group, value).agg(F.min(F.struct(*order)).alias("__first"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__first", F.col(value).alias("v")))), lambda s: s["v"]).alias(name))


def medoids(rows: DataFrame, group: str, id_col: str, vector_col: str) -> DataFrame:
    """(group, id): the row with the largest mean cosine to its group's rows, which is its dot product with their mean; ties by id."""
    places = rows.select(group, id_col, F.posexplode(vector_col).alias("i", "x"))
    means = places.groupBy(group, "i").agg(F.avg("x").alias("m"))
    scores = places.join(means, [group, "i"]).groupBy(group, id_col).agg(F.sum(F.col("x") * F.col("m")).alias("score"))
    first = Window.partitionBy(group).orderBy(F.round("score", 9).desc(), id_col)
    return scores.withColumn("__r", F.row_number().over(first)).where("__r = 1").select(group, id_col)


def medoid_texts(rows: DataFrame, group: str, text: str, dim: int = 256) -> DataFrame:
    """(group, text): of distinct texts, the one whose default embedding has the largest mean cosine to its group's; ties by text.

    The embeddings stay sparse rows, and groups of one text, which most are, need none.
    """
    several = rows.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"), F.min(text).alias("__only"))
    more = rows.join(several.where("__n > 1").select("__g"), F.col(group) == F.col("__g"), "left_semi")
    w = hashed_weights(more, [group, text], text, dim)
    sums = w.groupBy(group, "bucket").agg(F.sum("weight").alias("total"))
    scores = w.join(sums, [group, "bucket"]).groupBy(group, text).agg(F.sum(F.col("weight") * F.col("total")).alias("score"))
    scores = more.join(scores, [group, text], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    first = Window.partitionBy(group).orderBy(F.round("score", 9).desc(), text)
    best = scores.withColumn("__r", F.row_number().over(first)).where("__r = 1").select(group, text)
    return several.where("__n = 1").select(F.col("__g").alias(group), F.col("__only").alias(text)).unionByName(best)


def centroids(rows: DataFrame, group: str, vector_col: str) -> DataFrame:
    """(group, centroid): the mean vector, scaled to unit length."""
    means = rows.select(group, F.posexplode(vector_col).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("m"))
    lengths = means.groupBy(F.col(group).alias("__g")).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    scaled = means.join(lengths, F.col(group) == F.col("__g")).withColumn("u", F.when(F.col("n") > 1e-8, F.col("m") / F.col("n")).otherwise(F.col("m")))
    return scaled.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "u"))), lambda s: s["u"]).alias("centroid"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; the smaller name goes first, as the measure isn't symmetric."""
    return pd.Series([SequenceMatcher(None, *sorted((x, y))).ratio() for x, y in zip(a, b, strict=True)])


def name_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(F.greatest(X.token_jaccard(a, b), X.containment(a, b), sequence_ratio(a, b)))


def names_may_agree(cut: float, keys: bool = False):
    """Whether two names may reach a name_similarity, as a test on arrays of names.

    No matching of characters in order finds more of them than the names share in any order, and a name that holds the other
    shares all of that one's letters; so either 2 * shared letters reach the cut over all letters, or the tokens' Jaccard does,
    which is computed as it is. No pair that passes name_similarity is lost. With keys, the names are such (see functions.scope).
    """

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        names, where = np.unique(np.concatenate([a, b]).astype(object), return_inverse=True)
        names = [n.partition(scope.SEPARATOR)[2] for n in names.tolist()] if keys else names.tolist()
        bags, words = np.zeros((len(names), 64), np.int32), [list(dict.fromkeys(w for w in _SPACE.split(n) if w)) for n in names]
        known = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        tokens = np.full((len(names), max([1, *map(len, words)])), -1, np.int32)
        for i, n in enumerate(names):
            codes, counts = np.unique(np.frombuffer(n.encode("utf-32-le"), np.uint32) % 64, return_counts=True)
            bags[i, codes] = counts
            tokens[i, : len(words[i])] = [known[w] for w in words[i]]
        sizes, many = np.array([len(n) for n in names]), np.array([len(w) for w in words])
        x, y, out, turn = where[: len(a)], where[len(a) :], np.zeros(len(a), bool), max(1, (1 << 22) // tokens.shape[1] ** 2 // 4)
        for i in range(0, len(a), turn):
            p, q = x[i : i + turn], y[i : i + turn]
            letters = np.minimum(bags[p], bags[q]).sum(1, dtype=np.int64)
            same = ((tokens[p][:, :, None] == tokens[q][:, None, :]) & (tokens[p] >= 0)[:, :, None]).any(2).sum(1)
            out[i : i + turn] = (2 * letters >= (cut - 1e-9) * (sizes[p] + sizes[q])) | ((same > 0) & (same >= (cut - 1e-9) * (many[p] + many[q] - same)))
        return out

    return run


def _letters(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in its name, code modulo 64) of the letters of names."""
    count = np.array([len(n) for n in names], np.int64)
    row = np.repeat(np.arange(len(names)), count)
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32) % 64
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count), codes.astype(np.int64)


def _common(p: np.ndarray, q: np.ndarray, left: list[str], right: list[str]) -> np.ndarray:
    """At least how long the longest subsequence of the names of pairs is (letters modulo 64), eight bytes of bits a pair; of left names beyond 64 letters the length."""
    row, place, code = _letters(left)
    masks, short = np.zeros((len(left), 65), np.uint64), place < 64
    np.bitwise_or.at(masks, (row[short], code[short]), np.uint64(1) << place[short].astype(np.uint64))
    row, place, code = _letters(right)
    sizes, lengths = np.array([len(n) for n in left]), np.array([len(n) for n in right])
    wide = np.full((len(right), int(lengths.max(initial=1))), 64)
    wide[row, place] = code
    bits = np.full(len(p), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(int(lengths[q].max(initial=0))):
        met = bits & masks[p, wide[q, j]]
        bits = (bits + met) | (bits - met)
    own = np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - np.clip(sizes[p], 1, 64)).astype(np.uint64)
    return np.where(sizes[p] > 64, sizes[p], np.bitwise_count(~bits & own)).astype(np.int64)


def names_near(cut: float, keys: bool = False):
    """names_may_agree for all pairs of two arrays of names at once, as (p, q), places of those that may pass.

    Shared letters of all pairs are one matrix product, as the lesser of two counts is how many levels both reach. For the
    pairs that have enough of them the longest common subsequence, which no matching in order exceeds, stands instead.
    """

    def run(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sides = [[n.partition(scope.SEPARATOR)[2] for n in names] if keys else list(names) for names in (left.tolist(), right.tolist())]
        bags = []
        for names in sides:
            row, _, code = _letters(names)
            bags.append(np.bincount(row * 64 + code, minlength=64 * len(names)).reshape(len(names), 64))
        top = np.minimum(*[b.max(0, initial=0) for b in bags])  # levels that both sides reach
        code = np.repeat(np.arange(64), top)
        level = np.arange(len(code)) - np.repeat(np.cumsum(top) - top, top) + 1
        x, y = ((b[:, code] >= level).astype(np.float32) for b in bags)
        sizes = [np.array([len(n) for n in names], np.float32)[:, None] for names in sides]
        one = [np.ones_like(s) for s in sizes]
        # 2 * shared - cut * (both sizes), which single floats hold to far less than a thousandth
        over = np.concatenate([2 * x, -cut * sizes[0], one[0]], 1) @ np.concatenate([y, one[1], -cut * sizes[1]], 1).T
        p, q = np.nonzero(over >= -1e-3 * max(1.0, *(float(s.max(initial=1)) / 1000 for s in sizes)))
        keep = np.zeros(len(p), bool)
        for low in range(0, len(p), 1 << 16):
            i, j = p[low : low + (1 << 16)], q[low : low + (1 << 16)]
            keep[low : low + (1 << 16)] = 2 * _common(i, j, *sides) >= (cut - 1e-9) * (sizes[0][i, 0].astype(float) + sizes[1][j, 0])
        more_p, more_q = _sharing(*sides, cut)
        both = np.unique(np.concatenate([p[keep], more_p]) * len(right) + np.concatenate([q[keep], more_q]))
        return both // len(right), both % len(right)

    return run


def _sharing(left: list[str], right: list[str], cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose tokens' Jaccard reaches the cut; none for tokens that one name alone has."""
    words = [[list(dict.fromkeys(w for w in _SPACE.split(n) if w)) for n in names] for names in (left, right)]
    often = collections.Counter(w for n, ws in dict(zip(left + right, words[0] + words[1], strict=True)).items() for w in ws)
    known = {w: i for i, w in enumerate(w for w, n in often.items() if n > 1)}
    if not known:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    has = []
    for side in words:
        m = np.zeros((len(side), len(known)), np.float32)
        for i, ws in enumerate(side):
            m[i, [known[w] for w in ws if w in known]] = 1
        has.append(m)
    same, many = has[0] @ has[1].T, [np.array([len(ws) for ws in side]) for side in words]
    return np.nonzero((same > 0) & (same >= (cut - 1e-9) * (many[0][:, None] + many[1] - same)))


def tallies(rows: DataFrame, group: str, name: str, counted: dict[str, str]) -> DataFrame:
    """(group, mention_count, aliases, ...): rows, distinct names in order, and for each counted column how many values it has; each of them distinct before it is gathered or counted."""
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("mention_count"))
    aliases = rows.select(group, name).distinct().groupBy(F.col(group).alias("__g")).agg(F.array_sort(F.collect_list(name)).alias("aliases"))
    parts = [aliases, *[rows.select(group, c).distinct().groupBy(F.col(group).alias("__g")).agg(F.count(c).alias(n)) for c, n in counted.items()]]
    for part in parts:
        out = out.join(part, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    return out


def _voted(mentions: DataFrame, key: str) -> DataFrame:
    """(__c, normalized_name, entity_type, description, votes, __seen): the kinds of mentions of each cluster, how many there are of each and the first of them. All but the counts of units come from this table."""
    kinds = mentions.groupBy(F.col(key).alias("__c"), "normalized_name", "entity_type", "description")
    return written(kinds.agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("passage_id", "su_id", "mention_id")).alias("__seen")), "voted")


def _described(voted: DataFrame) -> DataFrame:
    """(__c, canonical_name, entity_type, canonical_description, embedding_text) of clusters."""
    votes = F.sum("votes")
    name = mode_by(voted, "__c", "normalized_name", [F.length("normalized_name"), F.col("normalized_name")], "canonical_name", votes)
    kind = mode_by(voted, "__c", "entity_type", [F.col("entity_type")], "entity_type", votes)
    middle = medoid_texts(voted.select("__c", "description").distinct(), "__c", "description").withColumnRenamed("description", "canonical_description")
    out = name.join(kind, "__c").join(middle, "__c")
    return out.withColumn("embedding_text", X.embedding_text(F.col("canonical_name"), F.col("canonical_description")))


def _records(voted: DataFrame, counts: DataFrame) -> DataFrame:
    """The cluster records of votes (see _voted) and counts (__u, su_count, passage_count) of clusters."""
    variants = first_appearances(voted, "__c", "description", ["__seen"], "description_variants")
    out = voted.groupBy("__c").agg(F.sum("votes").alias("mention_count"))
    aliases = voted.select("__c", "normalized_name").distinct().groupBy("__c").agg(F.array_sort(F.collect_list("normalized_name")).alias("aliases"))
    out = out.join(aliases, "__c").join(counts, F.col("__c") == F.col("__u")).drop("__u").join(variants, "__c").join(_described(voted), "__c")
    return out.withColumn("entity_id", X.content_id("entity-", F.col("embedding_text"))).withColumnRenamed("__c", "cluster")


def _supports(rows: DataFrame) -> DataFrame:
    """(__u, su_count, passage_count) of clusters, from their mentions (__c, su_id, passage_id) in one pass over these."""
    counts = rows.groupBy(F.col("__c").alias("__u")).agg(F.countDistinct("su_id").alias("su_count"), F.countDistinct("passage_id").alias("passage_count"))
    return counts.select("__u", *[F.col(c).cast("int").alias(c) for c in ("su_count", "passage_count")])


def clusters(mentions: DataFrame, key: str = "normalized_name") -> DataFrame:
    """The cluster records of mentions (a written table) by key: names, types, descriptions and counts. Which mentions, units and passages support one is an edge table (see merge_mentions), as a frequent entity has no bound on them."""
    return _records(_voted(mentions, key), _supports(mentions.select(F.col(key).alias("__c"), "su_id", "passage_id")))


def supporting(owners: DataFrame, of: str = "su_id") -> DataFrame:
    """(entity_id, of): the distinct units, passages or mentions of each entity, from the edges of merge_mentions."""
    return owners.select("entity_id", of).distinct()


#: What normalisation reads of a mention.
_KIND = ["normalized_name", "entity_type", "description", "surface_text"]


def _renamed(kinds: DataFrame) -> DataFrame:
    """kinds (a written table with __ before the columns of _KIND) with __n, __k, __d, their names, types and descriptions normalised once more, without low-value ones."""
    name, kind = X.normalize_name(F.col("__normalized_name")), X.normalize_type(F.col("__entity_type"))
    kinds = written(kinds.withColumns({"__n": name, "__k": kind, "__d": X.normalize_description(F.col("__description"), F.col("__surface_text"))}), "names")
    return kinds.where(~X.is_low_value(F.col("__n"), F.col("__k"), F.col("__d")))


def _same_kind() -> Column:
    return functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in _KIND])


def _of_kinds(mentions: DataFrame, kinds: DataFrame, table: DataFrame) -> DataFrame:
    """Mentions joined with their kinds, which are hashed where they are too many to be broadcast, so that no mention is sorted. table: a written one with as many rows as kinds."""
    return mentions.join(F.broadcast(kinds) if is_small(table) else kinds.hint("shuffle_hash"), _same_kind())


def normalised(mentions: DataFrame) -> DataFrame:
    """Mentions whose names are normalised once more, without low-value ones. Each name is normalised once, not each mention."""
    names = _renamed(written(mentions.select(*[F.col(c).alias(f"__{c}") for c in _KIND]).distinct(), "names"))
    new = {"normalized_name": "__n", "entity_type": "__k", "description": "__d"}
    return join_checked(mentions, written(names, "names"), _same_kind()).select(*[F.col(new.get(c, c)).alias(c) for c in mentions.columns])


def name_vectors(m: DataFrame, dim: int, key: str = "normalized_name") -> DataFrame:
    """(cluster, entity_type, embedding): the cluster of each name (or key) and its vector."""
    return _described(_voted(m, key)).select(F.col("__c").alias("cluster"), "entity_type", hashed_embedder(dim)(F.col("embedding_text")).alias("embedding"))


def name_links(vectors: DataFrame, cosine: float, name_cut: float, changed: DataFrame | None = None, many: bool = False) -> DataFrame:
    """(a, b, coordinate) with a < b: names of one type whose vectors and names agree; with changed (cluster), those that have one of them.

    The pair join gives only pairs whose names may agree, and the sequence ratio is computed for those that no cheaper part of
    name_similarity has decided; coordinate is one that both vectors have (see contracted). With many, clusters are keys of several corpora (see functions.scope), and names of one are linked.
    """
    kind = scope.beside(F.col("cluster"), F.col("entity_type")) if many else F.col("entity_type")
    entries = F.col("entries") if "entries" in vectors.columns else sparse_entries("embedding")
    rows = vectors.select("cluster", kind.alias("entity_type"), entries.alias("entries"))
    if changed is not None:
        rows = rows.join(changed.select(F.col("cluster").alias("new"), F.lit(True).alias("fresh")), F.col("cluster") == F.col("new"), "left").withColumn("fresh", F.coalesce("fresh", F.lit(False))).drop("new")
    pairs = sparse_pairs(rows, cosine, "cluster", "entity_type", "entries", names_near(name_cut, many), None if changed is None else "fresh")
    pairs = written(pairs.select("a", "b", "coordinate"), "pairs")
    a, b = (scope.bare(F.col(x)) if many else F.col(x) for x in ("a", "b"))
    near = (a == b) | (F.greatest(X.token_jaccard(a, b), X.containment(a, b)) >= name_cut)
    return pairs.where(near).unionByName(pairs.where(~near).where(sequence_ratio(a, b) >= name_cut))


def canonical(m: DataFrame, labels: DataFrame, dim: int, key: str = "normalized_name") -> tuple[DataFrame, DataFrame]:
    """(entities with their cluster, owners with their cluster) of normalised mentions; labels (node, component) of names (or keys) that are linked."""
    keyed = m.join(labels, F.col(key) == F.col("node"), "left").withColumn("component", F.coalesce("component", key)).drop("node")
    keyed = written(keyed, "merged")
    entities = written(clusters(keyed, "component").withColumn("embedding", hashed_embedder(dim)(F.col("embedding_text"))), "entities")
    owners = keyed.join(entities.select("cluster", "entity_id"), F.col("component") == F.col("cluster")).select("mention_id", "passage_id", "su_id", "entity_id", "cluster")
    return entities, owners


def merge_mentions(mentions: DataFrame, cosine: float = 0.90, name_cut: float = 0.72, floor: float = 0.90, dim: int = 256) -> tuple[DataFrame, DataFrame]:
    """(entities, mention to entity) of mentions (a written table): clusters of one type whose vectors and names are near become one, with their votes counted anew.

    Names are normalised once more first, and low-value mentions dropped again. The cosine cut is never below `floor`. All is done
    with the kinds of mentions, of which there are few to a name; mentions themselves are read for these, for the counts of units
    and passages, and for the owners.
    """
    prepare(mentions.sparkSession)
    seen = F.min(F.struct("passage_id", "su_id", "mention_id")).alias("__first")
    kinds = mentions.groupBy(*[F.col(c).alias(f"__{c}") for c in _KIND]).agg(F.count(F.lit(1)).alias("__votes"), seen)
    kinds = written(_renamed(written(kinds, "kinds")), "kinds")

    def voted(rows: DataFrame, key: str) -> DataFrame:
        each = rows.groupBy(F.col(key).alias("__c"), F.col("__n").alias("normalized_name"), F.col("__k").alias("entity_type"), F.col("__d").alias("description"))
        return written(each.agg(F.sum("__votes").alias("votes"), F.min("__first").alias("__seen")), "voted")

    vectors = _described(voted(kinds, "__n")).select(F.col("__c").alias("cluster"), "entity_type", hashed_entries(dim)(F.col("embedding_text")).alias("entries"))
    labels = connected_components(contracted(name_links(written(vectors, "clusters"), max(cosine, floor), name_cut), "coordinate"))
    merged = kinds.join(labels, F.col("__n") == F.col("node"), "left").withColumn("__c", F.coalesce("component", "__n")).drop("node", "component")
    merged = written(merged, "merged")
    of = [f"__{c}" for c in _KIND]
    counts = _supports(_of_kinds(mentions, merged.select(*of, "__c"), merged).select("__c", "su_id", "passage_id"))
    entities = written(_records(voted(merged, "__c"), counts).withColumn("embedding", hashed_embedder(dim)(F.col("embedding_text"))), "entities")
    named = merged.join(entities.select("cluster", "entity_id"), F.col("__c") == F.col("cluster")).select(*of, "entity_id")
    owners = _of_kinds(mentions, named, merged).select("mention_id", "passage_id", "su_id", "entity_id")
    return entities.drop("cluster"), owners
