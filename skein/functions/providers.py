"""What models would give, as pluggable providers, with deterministic offline defaults.

A provider is a callable on DataFrames or an Arrow function; the defaults need no model and are not meant to equal one.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.core import join_checked, prepare, written

from . import text as X
from .framing import Framer
from .grounding import places

_TOKEN = re.compile(r"\w+")


class _Buckets(dict):
    """The places of tokens, made when asked for; it begins anew when it is large."""

    def __init__(self, dim: int, most: int = 200_000):
        self.dim, self.most = dim, most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        place = self[token] = int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % self.dim
        return place


_buckets = functools.lru_cache(maxsize=8)(_Buckets)


def embed(texts: list[str | None], dim: int) -> np.ndarray:
    """Unit vectors of hashed token counts; zero for texts without tokens."""
    found = [_TOKEN.findall((t or "").lower()) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    bucket = np.fromiter(map(_buckets(dim).__getitem__, itertools.chain.from_iterable(found)), np.int64, len(row))
    out = np.bincount(row * dim + bucket, minlength=len(texts) * dim).reshape(len(texts), dim).astype(float)
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-12)[:, None]  # sums of whole numbers, so exact in any order
    return out


def hashed_embedder(dim: int) -> Callable[[Column], Column]:
    """The default embedder: a column of texts to a column of vectors."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            v = embed(texts.to_pylist(), dim).astype(np.float32)
            yield pa.ListArray.from_arrays(np.arange(0, v.size + 1, dim, dtype=np.int32), v.ravel())

    return run


def hashed_entries(dim: int) -> Callable[[Column], Column]:
    """The vectors of hashed_embedder without their zeros, as array<struct<i, w>>."""

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("w", T.DoubleType())])))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            v = embed(texts.to_pylist(), dim).astype(np.float32)
            row, place = np.nonzero(v)
            entries = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), pa.array(v[row, place].astype(float))], names=["i", "w"])
            yield pa.ListArray.from_arrays(np.searchsorted(row, np.arange(len(v) + 1)).astype(np.int32), entries)

    return run


def _places(letters: int):
    """Each unit's distinct tokens of so many letters with the place of the first one, so that no text leaves this step."""
    long_enough = re.compile(rf"\w{{{max(letters, 1)},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many, terms, at = [], [], []
            for text in b.column("text").to_pylist():
                first: dict[str, int] = {}
                for m in long_enough.finditer((text or "").lower()):
                    first.setdefault(m.group(), m.start())
                many.append(len(first))
                terms += first.keys()
                at += first.values()
            which = pa.array(np.repeat(np.arange(len(many)), many))
            yield pa.RecordBatch.from_arrays([b.column("passage_id").take(which), b.column("su_id").take(which), pa.array(terms, pa.string()), pa.array(at, pa.int32())], names=["passage_id", "su_id", "surface_text", "char_start"])

    return run


def salient_terms(units: DataFrame, least: int = 2, most: int = 20, letters: int = 5, share: float = 0.1, within: Callable[[Column], Column] | None = None, named: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The default mention extractor: terms of at least so many letters whose number of units lies in a band.

    The band ends at `most` units or that share of all units, whichever is more, so that it grows with the table and no term
    vanishes for that alone. Places are those of whole tokens in the lower-cased text. The texts are read once: the terms with
    their places are a table, from which both the counts and the mentions come.
    within: a unit's corpus, of its su_id; then each corpus has its own band and counts.
    named: what is made of names (see mentions.named), here once a term and not once a mention.
    units: (passage_id, su_id, text). Result: (passage_id, su_id, surface_text, entity_type, description, char_start, char_end).
    """
    prepare(units.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in units.schema}
    rows = units.select("passage_id", "su_id", "text")
    terms = written(rows.mapInArrow(_places(letters), f"passage_id {kinds['passage_id']}, su_id {kinds['su_id']}, surface_text string, char_start int"), "terms")
    if within is not None:
        each = units.select(within(F.col("su_id")).alias("corpus"), "su_id").distinct().groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))
        counts = terms.select(within(F.col("su_id")).alias("own"), "surface_text", "su_id").distinct().groupBy("own", F.col("surface_text").alias("term")).agg(F.count("su_id").alias("df"))
        band = F.col("df").between(least, F.greatest(F.lit(most), F.floor(F.col("n") * share)))
        counts = written(join_checked(counts, written(each, "corpora"), F.col("own") == F.col("corpus")).where(band).select("own", "term"), "kept-terms")
        found = _as_mentions(join_checked(terms, counts, (F.col("surface_text") == F.col("term")) & (within(F.col("su_id")) == F.col("own"))))
        return found if named is None else named(found)
    n, rows_in = units.select(F.countDistinct("su_id"), F.count(F.lit(1))).first()
    pairs = terms.select("surface_text", "su_id")
    if n < rows_in:  # else each row of terms is a unit's only one of its term
        pairs = pairs.distinct()
    counts = pairs.groupBy(F.col("surface_text").alias("term")).agg(F.count("su_id").alias("df"))
    kept = written(counts.where(F.col("df").between(least, max(most, int(n * share)))).select("term"), "kept-terms")
    if named is None:
        return _as_mentions(join_checked(terms, kept, F.col("surface_text") == F.col("term")))
    # From the written table: else the optimizer moves the tests of names below the count, to each row.
    kept = written(named(kept.select("term", F.col("term").alias("surface_text"), F.lit("term").alias("entity_type"), F.col("term").alias("description"))), "named-terms")
    found = terms.select("passage_id", "su_id", F.col("surface_text").alias("of"), "char_start", (F.col("char_start") + F.length("surface_text")).alias("char_end"))
    return join_checked(found, kept, F.col("of") == F.col("term")).drop("of", "term")


def _as_mentions(found: DataFrame) -> DataFrame:
    return found.select("passage_id", "su_id", "surface_text", F.lit("term").alias("entity_type"), F.col("surface_text").alias("description"), "char_start", (F.col("char_start") + F.length("surface_text")).alias("char_end"))


#: It counts units over the whole corpus, so it can't be asked about new units alone.
salient_terms.whole_corpus = True


def overlap_score(query: Column, passage: Column) -> Column:
    """The default reranker: the share of the query's tokens that the passage holds."""
    q = F.array_distinct(X.tokens(query))
    return F.coalesce(F.size(F.array_intersect(q, X.tokens(passage))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def extractive_answer(prompt: Column) -> Column:
    """The default reader: the head of the first passage of the prompt."""
    head = F.substring(F.get(F.split(prompt, "\n"), F.lit(0)), 1, 200)
    return F.concat(F.lit("Thought: the first passage is the best evidence. Answer: "), head)


def chat_provider(infer: Callable[[str], str]) -> Callable[[Column], Column]:
    """A reader, planner or judge, as a column of prompts to a column of answers, from a function on prompts; a failure gives an empty answer."""

    def answer(prompt: str | None) -> str:
        try:
            return infer(prompt or "") or ""
        except Exception:  # noqa: BLE001  a model's failure is an empty answer
            return ""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield prompts.map(answer)

    return run


def pair_provider(score: Callable, framer: Framer | None = None) -> Callable[[Column, Column], Column]:
    """A reranker, as (query, passage) columns to a column of scores, from a function on lists of pairs (see text.rerank_pair); a failed batch is tried again a pair at a time, and a failing pair scores 0.

    With a framer, whose budget is the model's in tokens, the function gets (ids, mask) with the padding on the left instead;
    without one it gets whole texts and cuts them as it needs.
    """

    def scores(pairs: list[str]) -> list[float]:
        try:
            return [float(x) for x in (score(pairs) if framer is None else score(*framer.padded(pairs)))]
        except Exception:  # noqa: BLE001  as above
            return [0.0] if len(pairs) == 1 else [x for p in pairs for x in scores([p])]

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pairs in batches:
            yield pd.Series(scores(pairs.tolist()), dtype="float64")

    return lambda query, passage: run(X.rerank_pair(X.RERANK_TASK, query, passage))


EXTRACTED = "passage_id string, su_id string, surface_text string, entity_type string, description string, char_start int, char_end int"


def extraction_provider(extract: Callable[[list[str]], list[list[dict]]], batch: int = 16) -> Callable[[DataFrame], DataFrame]:
    """A mention extractor from a function on lists of texts. A failed list is halved until the failing text stands alone, which then has no mentions; places that aren't given are looked up (see grounding), and a mention that has none isn't grounded."""

    def found(texts: list[str]) -> list[list[dict]]:
        try:
            out = extract(texts)
            if len(out) != len(texts):
                raise ValueError("an extractor answers each text")
            return out
        except Exception:  # noqa: BLE001  one text's failure is no other's
            if len(texts) == 1:
                return [[]]
            return found(texts[: len(texts) // 2]) + found(texts[len(texts) // 2 :])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, texts = [], [t or "" for t in b.column("text").to_pylist()]
            for i in range(0, len(texts), batch):
                for j, mentions in enumerate(found(texts[i : i + batch]), i):
                    looked = iter(places(texts[j], [str(m.get("text") or "") for m in mentions if m.get("start") is None]))
                    for m in mentions:
                        name, at = str(m.get("text") or ""), m.get("start")
                        place = (next(looked) or (None, None)) if at is None else (int(at), int(m.get("end") or at + len(name)))
                        out.append((str(b.column("passage_id")[j]), str(b.column("su_id")[j]), name, m.get("type"), m.get("description"), *place))
            columns = zip(*out, strict=True) if out else [()] * 7
            kinds = [pa.string()] * 5 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in EXTRACTED.split(", ")])

    return lambda units: units.select("passage_id", "su_id", "text").mapInArrow(rows, EXTRACTED)


def hosted_key(model: str, key: str | None, hosted: tuple[str, ...] = ("gpt", "gemini")) -> str | None:
    """The key for a model, which a hosted one (by the beginning of its name) can't do without."""
    if model.lower().startswith(hosted) and not key:
        raise ValueError(f"the hosted model {model!r} needs an API key")
    return key


def judged_correct(response: Column) -> Column:
    return F.when(F.lower(X.strip(F.coalesce(response, F.lit("")))) == "correct", 1).otherwise(0)
