"""N-gram Jaccard join: prefix-filtered candidates, verified by prefix trees of their whole sets.

All sets are exact wholes of their documents. Equal sets are one node. Shingles have one global order, rare ones first: by
their count over the nodes' first quarters where it reaches `heavy` (others count as equally rare), then by hash. Two sets
with a Jaccard similarity of at least 3/4 share one of the n - ceil(3n/4) + 1 first shingles of either in any such order; the
shingle's place in both and the sizes bound the overlap further. So:

1. nodes meet in buckets by those shingles; in each, the smallest is a pivot, and the others that it could link with are its
   candidates (a row for each, never a pair of each two); buckets of frequent shingles are split by node, and their pivots
   meet in turn; a candidate whose profile (how many of its shingles fall into each of 256 classes) shows that too few can be
   shared is none;
2. the sets of a pivot and of up to `block` of its candidates are put in a prefix tree in the same global order, which each set
   then walks: sets that begin alike share the partial overlap, and a subtree ends where what remains cannot reach the threshold;
3. links are joined to components; buckets that still hold several take turns with other pivots, and in those that hold
   several after that, all pairs of different components that the bounds allow are verified in the same way. Buckets that are
   in one component need no more.

Step 3 leaves out no pair, so the components are those of all links. Nothing is kept by sampling, nor capped.

Defined cases: null and wordless texts have an empty set and link with nothing; repeated rows agree; a null id is nobody's
component while another id is there; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, foreign_kept, join_checked, released, task_count, written
from .components import components
from .shingles import mix, shingle_sets

#: Counts from which a shingle is taken as frequent, at first; doubled until at most HEAVY_ROWS are, which are broadcast.
HEAVY, HEAVY_ROWS = 32, 1_000_000
#: Nodes of a frequent shingle that share a bucket, about.
BUCKET = 1024
#: Sets that share a prefix tree, about, and their shingles together.
BLOCK, BLOCK_SHINGLES = 64, 100_000
#: Turns with other pivots before all pairs that are left; nodes of a family, and their open shingles, of which two parts meet in one cell, about.
ROUNDS, CELL, CELL_ROWS = 1, 1024, 30_000
#: Open shingles up to which they are broadcast (five numbers each).
OPEN_ROWS = 1_000_000


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def profile(s: np.ndarray) -> bytes:
    """How many shingles have each first byte; 255 stands for that many or more."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1 if n else 0


class Order:
    """The global order: frequent shingles by count, after all others."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(tokens)
        self.tokens, self.counts = tokens[by], counts[by]

    def counts_of(self, s: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(s), np.int64)
        i = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[i] == s, self.counts[i], 0)

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first shingles of a sorted set, with their counts."""
        counts, p = self.counts_of(s), prefix_length(len(s))
        if not counts.any():
            return s[:p], counts[:p]
        by = np.lexsort((s, counts))[:p]
        return s[by], counts[by]


def _documents(k: int):
    """Each document's size and node; the first of a node in a task also has its profile and the first quarter of its set by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sizes, nodes, firsts, profiles = [], [], [], []
            for s in shingle_sets(b.column("text").to_pylist(), k):
                node = node_of(s) if len(s) else None
                sizes.append(len(s))
                nodes.append(node)
                new = node is not None and node not in seen
                firsts.append(s[: prefix_length(len(s))].view(np.int64) if new else None)
                profiles.append(profile(s) if new else None)
                if new:
                    seen.add(node)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(profiles, pa.binary())], names=["doc_id", "n_shingles", "node", "first", "profile"])

    return run


def _posting_batch(order: Order, sets: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(bucket, heavy, node, size, place) for the first shingles of (node, size, shingles, their counts)."""
    parts = []
    for node, size, tokens, counts in sets:
        split = -(-counts // BUCKET)
        salt = np.uint64(node & (2**64 - 1)) % np.maximum(split, 1).astype(np.uint64)
        bucket = np.where(split > 1, mix(tokens + mix(salt + np.uint64(1))), tokens)
        n = len(tokens)
        parts.append((bucket, tokens, counts > 0, np.full(n, node, np.int64), np.full(n, size, np.int32), np.arange(n, dtype=np.int32)))
    bucket, tokens, heavy, node, size, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(tokens.view(np.int64), mask=~heavy), pa.array(node), pa.array(size), pa.array(place)], names=["bucket", "heavy", "node", "size", "place"])


def _firsts(b: pa.RecordBatch) -> list[np.ndarray]:
    column = b.column("first")
    return [column[i].values.to_numpy().view(np.uint64) for i in range(b.num_rows)]


def _kept_postings(order):
    """Of nodes without frequent shingles among their first ones by hash: those are their first ones in the global order too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("node").to_pylist(), b.column("n_shingles").to_pylist(), _firsts(b), strict=True)
            sets = [(node, n, first, np.zeros(len(first), np.int64)) for node, n, first in rows if not order.value.counts_of(first).any()]
            if sets:
                yield _posting_batch(order.value, sets)

    return run


def _changed(order):
    """The documents of all other nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([bool(order.value.counts_of(first).any()) for first in _firsts(b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id")], names=["changed"]).filter(keep)

    return run


def _postings(order, k: int):
    """Postings of each node from its text, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sets = []
            for s in shingle_sets(b.column("text").to_pylist(), k):
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    sets.append((node, len(s), *order.value.prefix(s)))
            if sets:
                yield _posting_batch(order.value, sets)

    return run


def may_link(size_a, place_a, size_b, place_b):
    """Whether a shared shingle at these places, the first of the pair, leaves room for the overlap that a link needs."""
    left = np.minimum(size_a - place_a, size_b - place_b)
    return 7 * left.astype(np.int64) >= 3 * (size_a.astype(np.int64) + size_b)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket and size: those of shared buckets, each with the pivot that it could link with, if any.

    open: pairs without the pivot remain. A bucket of two has none, and gives its candidate alone.
    """
    names = ["bucket", "heavy", "node", "size", "place"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def of(rows: pa.Table, pivot: tuple | None):
        bucket, node, size, place = (rows[c].to_numpy() for c in ("bucket", "node", "size", "place"))
        heavy = rows["heavy"].is_valid().to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        if pivot and pivot[0] != bucket[0]:
            pivot = None
        ends = np.append(starts[1:], len(bucket))
        keep, pivots, has, left = heavy.copy(), np.zeros(len(bucket), np.int64), np.zeros(len(bucket), bool), heavy.copy()
        several = ends - starts > 1  # most buckets hold one node alone
        several[0] |= pivot is not None
        for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
            pivot = pivot if a == 0 else None
            start, left[a:b] = a, left[a:b] | (b - a > 2) | (pivot is not None)
            while a < b:
                if pivot is None:
                    pivot = (bucket[a], size[a], place[a], node[a])
                    a += 1
                    continue
                near = a + int(np.searchsorted(3 * size[a:b].astype(np.int64), 4 * int(pivot[1]), side="right"))
                ok = may_link(np.int64(pivot[1]), np.int64(pivot[2]), size[a:near], place[a:near]) & (node[a:near] != pivot[3])
                has[a:near], pivots[a:near] = ok, pivot[3]
                if near < b:
                    pivot = (bucket[near], size[near], place[near], node[near])
                    near += 1
                a = near
            keep[start:b] |= left[start:b] | has[start:b]
        out = rows.append_column("pivot", pa.array(pivots, mask=~has)).append_column("open", pa.array(left))
        return out.filter(pa.array(keep)), pivot

    held: pa.Table | None = None
    pivot = None
    started = False
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]).select(names)
        t = pa.concat_tables([held, t]) if held is not None else t
        bucket = t["bucket"].to_numpy()
        earlier = np.flatnonzero(bucket != bucket[-1])
        cut = int(earlier[-1]) + 1 if len(earlier) else 0
        if cut == 0 and len(bucket) > 65536:  # one bucket goes on: its pivot is carried over
            done, pivot = of(t, pivot)
            held = None
            yield from done.to_batches()
            continue
        if cut:
            done, _ = of(t.slice(0, cut), pivot)
            pivot = None
            yield from done.to_batches()
        held = t.slice(cut)
        started = True
    if held is not None and held.num_rows:
        done, _ = of(held, pivot)
        yield from done.to_batches()
    elif not started:
        yield pa.RecordBatch.from_arrays([pa.array([], k) for k in (*kinds, pa.int64(), pa.bool_())], names=[*names, "pivot", "open"])


# the prefix tree


class _Tree:
    """A prefix tree with joined edges: the ranks along its edge, its children, the sets that end here, and bounds of the subtree."""

    __slots__ = ("children", "depth", "edge", "ends", "largest", "smallest")

    def __init__(self, sets: list[np.ndarray], names: list[int], depth: int = 0):
        first, last = sets[0], sets[-1]
        n = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:n] != last[depth:n])
        upto = depth + int(differ[0]) if len(differ) else n
        self.edge, self.depth, self.children, self.ends = first[depth:upto], upto, [], []
        sizes = [len(s) for s in sets]
        self.smallest, self.largest = min(sizes), max(sizes)
        i = 0
        while i < len(sets) and len(sets[i]) == upto:
            self.ends.append(names[i])
            i += 1
        while i < len(sets):
            j = i + 1
            while j < len(sets) and sets[j][upto] == sets[i][upto]:
                j += 1
            self.children.append(_Tree(sets[i:j], names[i:j], upto))
            i = j


def tree_links(sets: list[np.ndarray], order: Order) -> list[tuple[int, int]]:
    """Links (i, j) between sets with a Jaccard similarity of 3/4 or more, as many as join their components (a spanning forest).

    The sets stand in the tree in the global order, by which they met.
    """
    sizes = [len(s) for s in sets]
    tokens, where = np.unique(np.concatenate(sets).view(np.uint64), return_inverse=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, order.counts_of(tokens)))] = np.arange(len(tokens))
    cuts = np.cumsum(sizes)[:-1]
    ranked = [np.sort(r) for r in np.split(rank[where], cuts)]
    sequence = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes())
    tree = _Tree([ranked[i] for i in sequence], sequence)
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links, mark = [], np.zeros(len(tokens), bool)
    for i, x in enumerate(ranked):
        mark[x] = True
        todo = [(tree, 0)]
        while todo:
            t, shared = todo.pop()
            if len(t.edge):
                shared += int(np.count_nonzero(mark[t.edge]))
                left = len(x) - int(np.searchsorted(x, t.edge[-1], side="right"))
            else:
                left = len(x) - shared
            if 7 * (shared + min(left, t.largest - t.depth)) < 3 * (len(x) + t.smallest) or 4 * t.largest < 3 * len(x) or 3 * t.smallest > 4 * len(x):
                continue
            for j in t.ends:
                if j < i and 7 * shared >= 3 * (len(x) + sizes[j]) and root(i) != root(j):
                    parent[root(i)] = root(j)
                    links.append((j, i))
            todo += [(c, shared) for c in t.children]
        mark[x] = False
    return links


def _block_links(order):
    def run(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        _, once = np.unique(nodes, return_index=True)
        sets = table["tokens"].combine_chunks()
        found = tree_links([sets[int(i)].values.to_numpy() for i in once], order.value) if len(once) > 1 else []
        return pa.table({"a": pa.array([int(nodes[once[i]]) for i, _ in found], pa.int64()), "b": pa.array([int(nodes[once[j]]) for _, j in found], pa.int64())})

    return run


def _whole_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for s in shingle_sets(b.column("text").to_pylist(), k) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "tokens"])

    return run


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose profiles leave room for a link: the smaller counts of each class bound the overlap."""
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, 256) for c in ("profile_a", "profile_b"))
            shared = np.minimum(x, y).sum(1, dtype=np.int64)
            full = ((x == 255) | (y == 255)).any(1)
            keep = full | (7 * shared >= 3 * (b.column("size_a").to_numpy() + b.column("size_b").to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("size_b")], names=["a", "b", "size"]).filter(pa.array(keep))


def _verified(pairs: DataFrame, docs: DataFrame, known: DataFrame, profiles: DataFrame, order, k: int, tasks: int) -> DataFrame:
    """The links (a, b) among the blocks of candidate pairs (a, b)."""
    pairs = pairs.select("a", "b").distinct()
    side = lambda c: profiles.select(F.col("node").alias(f"node_{c}"), F.col("n").alias(f"size_{c}"), F.col("profile").alias(f"profile_{c}"))
    both = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))
    pairs = written(both.mapInArrow(released(_possible), "a long, b long, size long"), "pairs", tasks)
    number = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES))
    counts = written(pairs.groupBy(F.col("a").alias("pivot")).agg(number.alias("blocks")), "pivots", tasks)
    blocks = join_checked(pairs, counts, pairs["a"] == counts["pivot"]).select("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), F.col("b").alias("node"))
    members = written(blocks.union(blocks.select("a", "block", F.col("a").alias("node"))).distinct(), "members", tasks)
    needed = members.select("node").distinct()
    reps = known.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    reps = written(reps.join(needed, "node", "left_semi").select("rep").distinct(), "needed", tasks)
    texts = join_checked(docs, reps, docs["doc_id"].eqNullSafe(reps["rep"]), "left_semi").select("text")
    sets = texts.mapInArrow(released(_whole_sets(k)), "node long, tokens array<long>")  # a row that repeats an id may come twice, which blocks allow for
    found = join_checked(sets, members, "node").groupBy("a", "block").applyInArrow(_block_links(order), "a long, b long")
    return written(found, "links", tasks)


@foreign_kept
def join_components(docs: DataFrame, k: int = 5, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs; component_id is the smallest id that links reach."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tasks, many = task_count(docs), task_count(docs, 4 << 20)
    known = written(docs.mapInArrow(released(_documents(k)), f"doc_id {kind}, n_shingles long, node long, first array<long>, profile binary"), "documents", many)
    counts = known.where("first is not null").select(F.explode("first").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= heavy)
    counts = written(counts, "frequent", tasks)
    firsts = known.where("first is not null").select("doc_id", "node", "n_shingles", "first")
    known = known.drop("first")
    while counts.where(F.col("n") >= heavy).count() > HEAVY_ROWS:
        heavy *= 2
    frequent = counts.where(F.col("n") >= heavy).toArrow()  # at most HEAVY_ROWS rows
    order = spark.sparkContext.broadcast(Order(frequent["token"].to_numpy().view(np.uint64), frequent["n"].to_numpy()))
    posting = "bucket long, heavy long, node long, size int, place int"
    changed = written(firsts.select("doc_id", "first").mapInArrow(released(_changed(order)), f"changed {kind}").distinct(), "changed", tasks)
    again = join_checked(docs, changed, docs["doc_id"].eqNullSafe(changed["changed"]), "left_semi").select("text").mapInArrow(released(_postings(order, k)), posting)
    posted = firsts.select("node", "n_shingles", "first").mapInArrow(released(_kept_postings(order)), posting).unionByName(again)
    posted = posted.repartition("bucket").sortWithinPartitions("bucket", "size", "node")
    shared = written(posted.mapInArrow(released(_stars), "bucket long, heavy long, node long, size int, place int, pivot long, open boolean"), "shared", many)
    pairs = shared.where("pivot is not null").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    tops = shared.where("heavy is not null and pivot is null").select("heavy", "node", "size")
    lead = written(tops.groupBy("heavy").agg(F.min(F.struct("size", "node")).alias("top")).select(F.col("heavy").alias("token"), F.col("top.size").alias("s"), F.col("top.node").alias("a")), "leads", tasks)
    across = join_checked(tops, lead, tops["heavy"] == lead["token"]).where((F.col("node") != F.col("a")) & (F.col("size") * 3 <= F.col("s") * 4)).select("a", F.col("node").alias("b"))
    profiles = written(known.where("profile is not null").select("node", F.col("n_shingles").alias("n"), "profile").dropDuplicates(["node"]), "profiles", many)
    known = known.drop("profile")
    check = lambda some: _verified(some, docs, known, profiles, order, k, tasks)
    links = check(pairs.union(across))
    comps = components(links, tasks)
    own = shared.where("open").select(F.coalesce("heavy", "bucket").alias("token"), "node", "size", "place")
    for turn in range(ROUNDS + 1):
        own = _open(own, comps, turn, tasks)
        if own.limit(1).count() == 0:
            break
        links = links.union(check(_pairs_left(own, profiles, tasks) if turn == ROUNDS else _stars_left(own)))
        comps = components(links, tasks)
    return _labelled(known, comps, tasks)


def _open(own: DataFrame, comps: DataFrame, turn: int, tasks: int) -> DataFrame:
    """(token, node, size, place, comp, p_*) of the shingles whose nodes are in several components; p_* is one of its nodes, another one each turn."""
    own = own.select("token", "node", "size", "place")
    own = join_checked(own, comps.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left")
    own = written(own.select("token", "node", "size", "place", F.coalesce("comp", "node").alias("comp")), "left", tasks)
    one = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("by"), "node", "size", "place", "comp")).alias("p")
    several = own.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), one).where("low < high")
    several = written(several.select(F.col("token").alias("p_token"), *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("node", "size", "place", "comp")]), "several", tasks)
    return written(join_checked(own, several, F.col("token") == F.col("p_token"), rows=OPEN_ROWS).drop("p_token"), "open", tasks)


def _room(a: str, b: str) -> Column:
    """may_link on columns."""
    left = F.least(F.col(f"{a}size") - F.col(f"{a}place"), F.col(f"{b}size") - F.col(f"{b}place"))
    return left * 7 >= (F.col(f"{a}size") + F.col(f"{b}size")) * 3


def _stars_left(own: DataFrame) -> DataFrame:
    """Candidates of one node of each open shingle."""
    return own.where((F.col("comp") != F.col("p_comp")) & _room("", "p_")).select(F.col("p_node").alias("a"), F.col("node").alias("b"))


def _cell_pairs(rows: pa.Table, profiles: pa.Table) -> pa.Table:
    """Once each, the pairs of a cell's nodes that some open shingle and their profiles allow."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not rows.num_rows:
        return none
    nodes, at = np.unique(profiles["node"].to_numpy(), return_index=True)
    counts = np.frombuffer(b"".join(profiles["profile"].take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, 256)
    total, part, i, j = profiles["n"].to_numpy()[at], profiles["part"].to_numpy()[at], rows["i"][0].as_py(), rows["j"][0].as_py()
    by = np.argsort(rows["token"].to_numpy(), kind="stable")
    token, node, size, place, comp = (rows[c].to_numpy()[by] for c in ("token", "node", "size", "place", "comp"))
    where, open_ = np.searchsorted(nodes, node), np.zeros((len(nodes), len(nodes)), bool)
    cuts = [0, *(np.flatnonzero(token[1:] != token[:-1]) + 1).tolist(), len(token)]
    for x, y in zip(cuts, cuts[1:], strict=False):
        s, p, c, w = size[x:y], place[x:y], comp[x:y], where[x:y]
        open_[np.ix_(w, w)] |= (c[:, None] != c) & may_link(s[:, None], p[:, None], s, p)
    low, high = np.nonzero(np.triu(open_ | open_.T, 1))
    inside = ((part[low] == i) & (part[high] == j)) | ((part[low] == j) & (part[high] == i))
    low, high = low[inside], high[inside]
    keep = [np.zeros(0, bool)]
    for x in range(0, len(low), 4096):
        u, v = counts[low[x : x + 4096]], counts[high[x : x + 4096]]
        shared = np.minimum(u, v).sum(1, dtype=np.int64)
        keep.append(((u == 255) | (v == 255)).any(1) | (7 * shared >= 3 * (total[low[x : x + 4096]] + total[high[x : x + 4096]])))
    ok = np.concatenate(keep)
    return pa.table({"a": pa.array(nodes[low[ok]]), "b": pa.array(nodes[high[ok]])})


def _pairs_left(own: DataFrame, profiles: DataFrame, tasks: int) -> DataFrame:
    """All pairs of different components that the bounds allow.

    Shingles of one family mostly have the same first node, by which they meet, so that a pair comes out once or a few times
    rather than for each shingle. The nodes of a large family are dealt to the cells of a grid.
    """
    keyed = own.select(F.col("p_node").alias("family"), "token", "node", "size", "place", "comp")
    members = keyed.select("family", "node").distinct()
    sizes = keyed.groupBy(F.col("family").alias("f")).agg(F.greatest(F.ceil(F.count_distinct("node") / CELL), F.ceil(F.count(F.lit(1)) / CELL_ROWS)).cast("int").alias("parts"))
    parts = written(sizes, "parts", tasks)

    def dealt(df: DataFrame) -> DataFrame:
        df = join_checked(df, parts, F.col("family") == F.col("f")).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
        return df.withColumn("cell", F.explode(cells)).select("*", "cell.i", "cell.j").drop("f", "parts", "cell")

    known = join_checked(profiles, members.select(F.col("node").alias("__n")).distinct(), F.col("node") == F.col("__n"), "left_semi")
    placed = written(dealt(members.join(known, "node")), "placed", tasks)
    return dealt(keyed).groupBy("family", "i", "j").cogroup(placed.groupBy("family", "i", "j")).applyInArrow(_cell_pairs, "a long, b long")


def _labelled(known: DataFrame, comps: DataFrame, tasks: int) -> DataFrame:
    joined = join_checked(known, comps.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left")
    joined = written(joined.select("doc_id", "n_shingles", F.coalesce("comp", "node").alias("comp")), "labelled", tasks)
    least = joined.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = written(least.select(F.col("comp").alias("__c"), "least"), "least", tasks)
    out = join_checked(joined, least, F.col("comp") == F.col("__c"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


@foreign_kept
def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component alone, that of the smallest id (null last); same columns. Of rows that repeat id and text, one stays."""
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    key = F.col("doc_id")
    if shared:  # rows that share an id, or have none, are rows of their own
        key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"), F.col("text").isNull().alias("no_text"))
    keyed = docs.withColumn("__key", key)
    removed = join_components(keyed, id_col="__key").where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__removed")).distinct()
    removed = written(removed, "removed", task_count(docs))
    kept = join_checked(keyed, removed, F.col("__key").eqNullSafe(F.col("__removed")), "left_anti")
    return (kept.dropDuplicates(["__key"]) if shared else kept).drop("__key")
