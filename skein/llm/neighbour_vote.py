"""Quality by nearest neighbours: labelled latent-semantic vectors are broadcast, every document's cosine products with all of
them are computed in blocks, and the nearest ones vote with weights that rise with similarity.

Features are counts of hashed character trigrams of the text as it is (case, digits and marks kept), damped by logarithm,
weighted by inverse document frequency in the sample and scaled to unit length, beside a few shares (words that repeat the one
before, marks, capitals, digits) that trigrams show badly; a truncated singular value decomposition of
the sample's matrix gives the latent space. The sample is the `sample` labelled rows with the smallest hashes of their ids
(all, where there are fewer): a bounded number, which is the only bound here. All documents are scored over their whole texts.

Defined cases: a null, empty or one-character text has no features, is similar to nothing, and scores the sample's share of
label 1, as does every text where no row is labelled (then a half); null labels don't count; of repeated labels of one id the
smallest counts; repeated rows agree; an empty table gives an empty result; other columns stay, those named like new ones are
replaced.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded_batches, foreign_kept, released

BUCKETS = 4096
#: Shares beside the trigrams, in units of which 65535 are the whole, and their weights against a text's trigrams.
SHARES, SHARE_WEIGHTS = 4, np.array([1.2, 1.2, 0.6, 0.6], np.float32)
#: Labelled rows that are learnt from at most.
SAMPLE = 3000
LATENT, NEIGHBOURS, SHARPNESS = 48, 25, 8.0
#: Documents whose products with all labelled vectors are computed at once.
BLOCK = 256


def features(texts: list[str | None]) -> np.ndarray:
    """Rows of counts of hashed byte trigrams and then the shares, as 32-bit floats."""
    out = np.zeros((len(texts), BUCKETS + SHARES), np.float32)
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
        if len(raw):
            words = t.split()
            repeats = sum(map(operator.eq, words, words[1:])) / max(1, len(words) - 1)
            kinds = np.add.reduceat(np.bincount(raw, minlength=256), [0, 33, 48, 58, 65, 91, 97, 123, 128])
            marks, capitals, digits = kinds[1] + kinds[3] + kinds[5] + kinds[7], kinds[4], kinds[2]
            out[i, BUCKETS:] = np.round(65535 * np.array([repeats, marks / len(raw), capitals / len(raw), digits / len(raw)]))
        for start in range(0, len(raw) - 2, 1 << 20):
            b = raw[start : start + (1 << 20) + 2].astype(np.uint32)
            if len(b) < 3:
                continue
            h = (b[:-2] * np.uint32(0x1000193) ^ b[1:-1] * np.uint32(0x9E3779B1) ^ b[2:] * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
            out[i, :BUCKETS] += np.bincount(h >> np.uint32(20), minlength=BUCKETS)
    return out


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(rows[:, :BUCKETS]) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return np.concatenate([x, rows[:, BUCKETS:] * (SHARE_WEIGHTS / np.float32(65535))], 1)


@dataclass
class Model:
    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; zero where there is nothing."""
        z = weighted(rows, self.idf) @ self.project
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for i in range(0, len(counts), BLOCK):
            z = self.latent(counts[i : i + BLOCK])
            cos = z @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            c = np.take_along_axis(cos, near, 1).astype(np.float64)
            w = np.exp(SHARPNESS * (c - c.max(1, keepdims=True)))
            s = (w * self.labels[near]).sum(1) / w.sum(1)
            out[i : i + BLOCK] = np.where(np.abs(z).sum(1) > 0, s, self.prior)
        return np.clip(out, 0.0, 1.0)


def fit(counts: np.ndarray, labels: np.ndarray, latent: int = LATENT, seed: int = 5) -> Model:
    """Randomised singular value decomposition of the damped, weighted counts."""
    if not len(labels):
        return Model(np.ones(BUCKETS, np.float32), np.zeros((BUCKETS + SHARES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    idf = np.log((1 + len(counts)) / (1 + (counts[:, :BUCKETS] > 0).sum(0))).astype(np.float32) + np.float32(1)
    x = weighted(counts, idf)
    rng, width = np.random.default_rng(seed), min(latent + 10, *x.shape)
    q = np.linalg.qr(x.T @ rng.normal(size=(len(x), width)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    small = x @ q
    values, vectors = np.linalg.eigh(small.T @ small)
    keep = np.argsort(values)[::-1][: min(latent, width)]
    model = Model(idf, np.ascontiguousarray(q @ vectors[:, keep], np.float32), np.zeros((0, 1), np.float32), labels.astype(np.float64), float(labels.mean()))
    model.vectors = model.latent(counts).astype(np.float32)
    return model


def held_out(id_col: Column) -> Column:
    """Whether labels of an id are kept from learning."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, BLOCK):
            part = b.slice(i, BLOCK)
            counts = features(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([np.minimum(c, 65535).astype("<u2").tobytes() for c in counts], pa.binary())], names=["label", "counts"])


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of at most `sample` labelled rows that aren't held out."""
    bounded_batches(docs.sparkSession)
    own = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("label"))
    own = own.orderBy(F.xxhash64("__id"), "__id").limit(sample)  # `sample` rows
    texts = docs.join(F.broadcast(own), docs[id_col] == own["__id"]).select("label", F.col(text_col).alias("text"), F.col("__id"))
    rows = texts.dropDuplicates(["__id"]).select("__id", "label", "text").repartition(8, "__id").sortWithinPartitions("__id").select("label", "text")
    got = rows.mapInArrow(released(_features), "label int, counts binary").toArrow()  # 8 KB a row
    if not got.num_rows:
        return fit(np.zeros((0, BUCKETS + SHARES), np.float32), np.zeros(0))
    counts = np.frombuffer(b"".join(got["counts"].to_pylist()), "<u2").reshape(-1, BUCKETS + SHARES).astype(np.float32)
    y = got["label"].to_numpy()
    by = np.lexsort((y, *counts[:, :4].T))  # rows come in any order; sums are the same in one order
    return fit(counts[by], y[by])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            names = [c for c in b.schema.names if c != "__text"]
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                s = m.score(features(part.column("__text").to_pylist()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(s, pa.float64())], names=[*names, "score"])

    return run


@foreign_kept
def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, keep: list[str] | None = None, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs (None: all), with held_out, score and predicted."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, labels, label_col, sample, id_col, text_col))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("held_out", "score", "predicted")]
    rows = docs.select(*keep, held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("__text"))
    schema = T.StructType([f for f in rows.schema if f.name != "__text"] + [T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(released(_score(model)), schema).withColumn("predicted", (F.col("score") >= cut).cast("int"))
