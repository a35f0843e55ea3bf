"""Passages, sentences and semantic units."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.core import prepare
from skein.functions import providers
from skein.functions import text as X

from .ordering import in_order


def fixed_windows(docs: DataFrame, id_col: str, text_col: str, size: int = 1200, overlap: int = 100) -> DataFrame:
    """(id, chunk_no, text): windows of `size` white-space tokens, each `overlap` back; the one that reaches the end is the last."""
    if size <= overlap:
        raise ValueError("the overlap must be less than the window")
    words = docs.select(id_col, F.filter(F.split(F.coalesce(text_col, F.lit("")), r"\s+"), lambda w: w != "").alias("w"))
    n, step = F.size("w"), size - overlap
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    chunks = words.where(n > 0).select(id_col, "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return chunks.select(id_col, "chunk_no", F.array_join(F.slice("w", F.col("chunk_no") * step + 1, F.lit(size)), " ").alias("text"))


def sentences(docs: DataFrame, id_col: str, text_col: str, longer_than: int = 10) -> DataFrame:
    """(id, pos, sentence)."""
    return docs.select(id_col, F.posexplode(X.sentences(F.col(text_col), longer_than)).alias("pos", "sentence"))


def adjacent_distance(vectors: DataFrame, group: str, order: list[str], vector_col: str) -> DataFrame:
    """Each row's cosine distance to the next in its group, null for the last."""
    from skein.functions.vectors import dot

    w = Window.partitionBy(group).orderBy(*order)
    return vectors.withColumn("distance", 1 - dot(F.col(vector_col), F.lead(vector_col).over(w)))


def percentile_groups(distances: DataFrame, group: str, order: list[str], percentile: float = 60.0) -> DataFrame:
    """unit_no of each row: a new unit begins after a distance strictly above the group's percentile (linear interpolation)."""
    cut = distances.groupBy(F.col(group).alias("__g")).agg(F.percentile("distance", F.lit(percentile / 100)).alias("threshold"))
    rows = distances.join(cut, F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")
    w = Window.partitionBy(group).orderBy(*order)
    after = F.coalesce((F.lag("distance").over(w) > F.col("threshold")).cast("int"), F.lit(0))
    return rows.withColumn("__after", after).withColumn("unit_no", F.sum("__after").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__after")


def unit_texts(rows: DataFrame, group: str, unit: str = "unit_no", order: str = "pos", text_col: str = "sentence") -> DataFrame:
    """(group, unit, text): the sentences of a unit joined by spaces in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, text_col)))
    return rows.groupBy(group, unit).agg(F.array_join(F.transform(parts, lambda s: s[text_col]), " ").alias("text"))


# The two procedures below decide each step on the ones before, so they run within one passage at a time.


def semantic_cuts(tokens: list[int], gaps: list[float], size: int, window: float = 0.2) -> list[tuple[int, int]]:
    """Sentence ranges of chunks: each ends at the widest gap among boundaries near `size` tokens."""
    lo, hi, out, start = int(size * (1 - window)), int(size * (1 + window)), [], 0
    total = np.concatenate([[0], np.cumsum(tokens)])
    while start < len(tokens):
        used = total[start + 1 :] - total[start]
        fits = int(np.searchsorted(used, hi, side="right"))
        if start + fits >= len(tokens):
            out.append((start, len(tokens)))
            break
        near = [i for i in range(fits) if used[i] >= lo]
        if near:
            cut = max(near, key=lambda i: gaps[start + i])  # the first of the widest
        else:
            cut = max(int(np.searchsorted(used[:fits], size, side="right")) - 1, 0)
        out.append((start, start + cut + 1))
        start += cut + 1
    return out


def _joined(groups: list[list[int]], words: np.ndarray, vectors: np.ndarray, least: int) -> list[list[int]]:
    """The smallest unit, the first of equals, joins the neighbour that is more like it until all are long enough. A heap finds it, and sums stand for means, so a passage costs n log n."""
    n = len(groups)
    sizes, sums = [int(words[g].sum()) for g in groups], [vectors[g].sum(0) for g in groups]
    counts, left, right, live = [len(g) for g in groups], [*range(-1, n - 1)], [*range(1, n), -1], n
    heap = [(size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    means: list[np.ndarray | None] = [None] * n

    def mean(i: int) -> np.ndarray:
        if means[i] is None:
            v = sums[i] / counts[i]
            size = np.linalg.norm(v)
            means[i] = v / size if size > 1e-8 else v
        return means[i]

    while heap and live > 1:
        size, i = heapq.heappop(heap)
        if groups[i] is None or size != sizes[i]:
            continue
        if size >= least:
            break
        own, x, y = mean(i), left[i], right[i]
        near = [float(mean(j) @ own) if j >= 0 else -1.0 for j in (x, y)]
        if max(near) <= -1.0:
            break
        a, b = (x, i) if near[0] >= near[1] else (i, y)
        groups[a] += groups[b]
        sizes[a], sums[a], counts[a], right[a] = sizes[a] + sizes[b], sums[a] + sums[b], counts[a] + counts[b], right[b]
        means[a] = None
        if right[b] >= 0:
            left[right[b]] = a
        groups[b], live = None, live - 1
        heapq.heappush(heap, (sizes[a], a))
    return [g for g in groups if g is not None]


def balanced(groups: list[list[int]], words: list[int], vectors: np.ndarray, least: int = 20, most: int = 200) -> list[list[int]]:
    """Short units join the neighbour that is more like them; long ones are cut at their widest gaps while both parts stay long enough."""
    count, gap = np.asarray(words, np.int64), 1 - (vectors[:-1] * vectors[1:]).sum(1)  # a group's sentences follow one another
    out, todo = [], _joined([list(g) for g in groups], count, vectors, least)[::-1]
    while todo:
        g = todo.pop()
        upto = np.cumsum(count[g])
        at = np.flatnonzero((upto[:-1] >= least) & (upto[-1] - upto[:-1] >= least)) if upto[-1] > most else []
        gaps = gap[g[0] + at] if len(at) else np.zeros(0)
        if len(gaps) and gaps.max() > -1.0:
            k = int(at[int(np.argmax(gaps))]) + 1  # the first of the widest
            todo += [g[k:], g[:k]]
        else:
            out.append(g)
    return out


def semantic_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1200, window: float = 0.2, dim: int = 256, count: Callable[[str], int] | None = None) -> DataFrame:
    """(id, chunk_no, text): fixed token target with semantic boundaries; a text without sentences is one chunk.

    count: how many tokens a sentence has, as a model's tokenizer tells; by default its words. Gaps are compared to nine digits.
    """
    prepare(docs.sparkSession)
    count = count or (lambda s: len(providers._TOKEN.findall(s)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for key, text, cut in zip(pdf[id_col], pdf["__text"], pdf["__cut"], strict=True):
                cut = list(cut)
                if not cut:
                    if text and text.strip():
                        rows.append((key, 0, text.strip()))
                    continue
                v = providers.embed(cut, dim)
                gaps = [*np.round(1 - (v[:-1] * v[1:]).sum(1), 9), 0.0]
                rows += [(key, k, " ".join(cut[a:b])) for k, (a, b) in enumerate(semantic_cuts([count(s) for s in cut], gaps, size, window))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_no", "text"])

    rows = docs.select(id_col, F.col(text_col).alias("__text"), X.sentences(F.col(text_col), 5).alias("__cut"))
    return rows.mapInPandas(run, f"{id_col} {kind}, chunk_no int, text string")


#: Bytes of texts whose units a task makes at once, about.
UNITS_AT_ONCE = 1 << 20


def _unit_groups(cut: list[str], percentile: float, least: int, most: int, dim: int) -> list[list[int]]:
    """The sentences, by place, of each unit of a text."""
    if len(cut) <= 1:
        return [[0]] if cut else []
    v = providers.embed(cut, dim)
    gaps = np.round(1 - (v[:-1] * v[1:]).sum(1), 9)
    edges = np.flatnonzero(gaps > np.percentile(gaps, percentile) + 1e-9) + 1
    groups = [g.tolist() for g in np.split(np.arange(len(cut)), edges)]
    return balanced(groups, [len(s.split()) for s in cut], v, least, most)


def _sentence_rows(passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, __text, __cut): a text's sentences, and the trimmed text itself only where it has none."""
    rows = passages.select(id_col, F.col(text_col).alias("__text"), X.sentences(F.col(text_col)).alias("__cut"))
    return rows.withColumn("__text", F.when(F.size("__cut") == 0, F.col("__text")))


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some bytes, so that what Python holds beside it doesn't grow with the batch."""
    each = max(1, b.num_rows * UNITS_AT_ONCE // max(b.nbytes, 1))
    for low in range(0, b.num_rows, each):
        yield b.slice(low, each)


def semantic_units(passages: DataFrame, id_col: str, text_col: str, percentile: float = 60.0, least: int = 20, most: int = 200, dim: int = 256) -> DataFrame:
    """(id, pos, text): percentile groups of sentences, balanced. A row is a passage, so nothing is shuffled."""
    prepare(passages.sparkSession)
    kind = passages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in _slices(batch)):
            which, pos, out = [], [], []
            for i, (text, cut) in enumerate(zip(b.column("__text").to_pylist(), b.column("__cut").to_pylist(), strict=True)):
                units = [" ".join([cut[k] for k in g]) for g in _unit_groups(cut, percentile, least, most, dim)] or ([text.strip()] if text and text.strip() else [])
                which += [i] * len(units)
                pos += range(len(units))
                out += units
            ids = b.column(id_col).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int32()), pa.array(out, pa.string())], names=[id_col, "pos", "text"])

    return _sentence_rows(passages, id_col, text_col).mapInArrow(run, f"{id_col} {kind}, pos int, text string")


def unit_counts(passages: DataFrame, id_col: str, text_col: str, percentile: float = 60.0, least: int = 20, most: int = 200, dim: int = 256) -> DataFrame:
    """(id, n_units, n_sentences) of the passages that have a unit: as semantic_units makes them, but their texts don't leave the task."""
    prepare(passages.sparkSession)
    kind = passages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in _slices(batch)):
            units, sentences = [], []
            for text, cut in zip(b.column("__text").to_pylist(), b.column("__cut").to_pylist(), strict=True):
                units.append(len(_unit_groups(cut, percentile, least, most, dim)) or int(bool(text and text.strip())))
                sentences.append(len(cut))
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(units, pa.int64()), pa.array(sentences, pa.int64())], names=[id_col, "n_units", "n_sentences"])

    return _sentence_rows(passages, id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_units long, n_sentences long").where("n_units > 0")


def unit_stats(units: DataFrame, id_col: str) -> DataFrame:
    """One row: how many units there are, and how many a passage has on average."""
    n = units.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("n_units"), F.avg("n").alias("per_passage"))


def chunk_corpus(docs: DataFrame, id_col: str, text_col: str, size: int = 1200, overlap: int = 100, semantic: bool = True, window: float = 0.2, count: Callable[[str], int] | None = None) -> DataFrame:
    """(id, chunk_no, text): chunks of about `size` tokens, cut at semantic boundaries (count: see semantic_chunks) or (semantic=False) in overlapping windows."""
    return semantic_chunks(docs, id_col, text_col, size, window, count=count) if semantic else fixed_windows(docs, id_col, text_col, size, overlap)


def adjacency(passages: DataFrame, text_col: str = "text", id_col: str = "passage_id", within: list[str] | None = None) -> DataFrame:
    """(src, dst, weight) between passages with successive index prefixes, within a corpus (without `within`, all are one, which no single task sorts)."""
    within = within or []
    rows = passages.select(*within, F.col(id_col).alias("src"), X.index_prefix(F.col(text_col)).alias("idx")).where("idx is not null")
    placed = in_order(rows, within, ["idx", "src"], rank=None, nexts={"dst": "src"})
    return placed.select(*within, "src", "dst").where("dst is not null").withColumn("weight", F.lit(1.0))
