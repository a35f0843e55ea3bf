"""Quality rules: base limits, and robust multivariate outliers by minimum covariance determinants per language and source.

Each text gives counts, and from them a vector of six transformed statistics in whole 1024ths. For each pool of documents
that pass the base limits, the estimate is sought from several starts: the medians and median absolute deviations, the moments of
all rows, and those of either half of the rows by hash. Each start takes concentration steps (means and covariances of the half
of the rows that is nearest) for as long as the determinant of the covariance falls, and the pool keeps the start that ends at
the least determinant; that is reweighted over the rows within the 97.5 % ellipsoid. A row is rejected when its Mahalanobis
distance exceeds the limit. All sums are of whole numbers, so a task that runs again, or rows in another order, change nothing.
Every step is an aggregation with partial sums over all rows; a group however large is never in one task: a pool sends some
hundred numbers a task, its distances as counts in bins of a sixteenth of an octave (the half is filled up to the end of its bin).

Pools: a language and source with at least `least` rows; the smaller ones of a language together; where those are too few, they
join the language's largest; languages without any are one pool, or join the largest of all; with fewer than `least` rows in
every language and source and together, no estimate is made and the base limits decide.

Floors, whose squares are added to the variances, follow from no labels. For four statistics they are of numerical size, so that
a pool's covariance alone sets the distance. Repeated lines and words are zero in most clean documents, so that the nearest half
says nothing of their scale; there the floor is one repetition in a document of median size: one line of the median number of
lines, and the six words of two windows of the median number of words, over all rows that pass the base limits.

Defined cases: a null text is empty and fails; null language or source is a value of its own; repeated rows count as often as
they occur and are judged alike; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded_batches, foreign_kept, join_checked, released, task_count, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCALE = 1024
#: The transformed statistics; the floor of most is the step of whole 1024ths, which decides nothing.
NAMES = ("log words", "log word length", "symbols a character", "repeated lines", "repeated words", "capitals a character")
STEP = 1 / SCALE
#: Words that a repetition of a window of three words covers at least, where its two windows don't overlap.
REPEATED = 6
D = len(NAMES)
#: Concentration steps that a start takes at most (they end much sooner, when the determinant falls no more), and the rows of a
#: pool at least: twenty for each statistic, so that the nearest half still has ten.
MIN_WORDS, STEPS, LEAST = 50, 40, 20 * D
CUT_PROBABILITY, REWEIGHT = 1e-6, 0.975
_X = [f"__x{i}" for i in range(D)]


def chi2_cdf(x: float, d: int) -> float:
    """Of the chi-squared distribution with an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, d // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """What makes the covariance of the nearest share of normal rows that of all."""
    if share >= 1:
        return 1.0
    return share / chi2_cdf(chi2_quantile(share, D), D + 2)


def statistics(text: str | None) -> tuple[int, ...]:
    """STATS, the number of lines with a word, and the number of capitals A-Z."""
    text = text or ""
    words = WORD.findall(text)
    n, repeated = len(words), 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            hit = bytearray(n)
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    hit[i : i + 3] = b"\1\1\1"
            repeated = sum(hit)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    capitals = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated, len(lines), capitals


def vector(stats: tuple[int, ...]) -> tuple[int, ...]:
    """The transformed statistics in whole 1024ths."""
    n, chars, symbols, dup, repeated, lines, capitals = stats
    x = (math.log1p(n), math.log1p(chars / max(n, 1)), symbols / max(chars, 1), dup / max(lines, 1), repeated / max(n, 1), capitals / max(chars, 1))
    return tuple(round(v * SCALE) for v in x)


def floors_of(lines: float | None, words: float | None) -> list[float]:
    """The floors by the median numbers of lines and words."""
    return [STEP, STEP, STEP, max(STEP, 1 / max(lines or 1, 1)), max(STEP, REPEATED / max(words or REPEATED, REPEATED)), STEP]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t) for t in b.column("__text").to_pylist()]
        vectors = [vector(r) for r in rows]
        out = [b.column(i) for i, c in enumerate(b.schema.names) if c != "__text"]
        out += [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(STATS) + 1)] + [pa.array([v[i] for v in vectors], pa.int64()) for i in range(D)]
        yield pa.RecordBatch.from_arrays(out, names=[*[c for c in b.schema.names if c != "__text"], *[f"__{s}" for s in STATS], "__n_lines", *_X])


def _inverse(share: float, floors: list[float]):
    """Moments to mean, inverse covariance with the floors, in units of the statistics, and the logarithm of its determinant."""
    factor, added = consistency(share), np.diag(np.array(floors) ** 2)
    pairs = [(i, j) for i in range(D) for j in range(i, D)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            means, inverses, sizes = [], [], []
            for n, s, ss in zip(*(b.column(c).to_pylist() for c in ("n", "s", "ss")), strict=True):
                cov = np.empty((D, D))
                for (i, j), v in zip(pairs, ss, strict=True):
                    cov[i, j] = cov[j, i] = (v * n - s[i] * s[j]) / (n * n * SCALE * SCALE)  # whole numbers up to the division
                cov = factor * cov + added
                means.append([x / (n * SCALE) for x in s])
                inverses.append(np.linalg.inv(cov).ravel().tolist())
                sizes.append(float(np.linalg.slogdet(cov)[1]))
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("pool"), b.column("start"), pa.array(means, kind), pa.array(inverses, kind), pa.array(sizes, pa.float64())], names=["pool", "start", "mean", "inverse", "size"])

    return run


PARAMS = "pool string, start int, mean array<double>, inverse array<double>, size double"


def _distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    """The squared Mahalanobis distance of a row from the estimate beside it."""
    d = [F.col(x) / float(SCALE) - F.col(mean)[i] for i, x in enumerate(_X)]
    return sum((d[i] * d[j] * F.col(inverse)[i * D + j] * (1.0 if i == j else 2.0) for i in range(D) for j in range(i, D)), F.lit(0.0))


def _pools(counts: DataFrame, least: int) -> DataFrame:
    """(key, pool) for each language and source."""
    small, own = F.when(F.col("n") < least, F.col("n")).otherwise(0), F.concat(F.lit("s"), F.col("key"))
    lang = Window.partitionBy("lang")
    largest = F.when(F.col("n") >= least, F.struct("n", own.alias("pool")))
    counts = counts.withColumn("in_lang", F.sum(small).over(lang)).withColumn("of_lang", F.max(largest).over(lang))
    alone = (F.col("n") < least) & (F.col("in_lang") < least) & F.col("of_lang").isNull()
    all_rows = counts.agg(F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("rest"), F.max(largest).alias("of_all"))
    pool = F.when(F.col("n") >= least, own).when(F.col("in_lang") >= least, F.concat(F.lit("l"), F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))))
    pool = F.coalesce(pool, F.col("of_lang.pool"), F.when(F.col("rest") >= least, F.lit("*")), F.col("of_all.pool"))
    return counts.crossJoin(F.broadcast(all_rows)).select("key", pool.alias("pool"))  # all_rows is one row


def _estimates(rows: DataFrame, pools: DataFrame, steps: int, floors: list[float], tasks: int) -> DataFrame:
    """(key, pool, start, mean, inverse, size) of each language and source that has an estimate. rows: key and vector of what passes the base limits."""
    pooled = pools.where("pool is not null")

    def by_key(params: DataFrame) -> DataFrame:
        return written(pooled.join(params, "pool"), "mcd", tasks)

    def moments(near: DataFrame, share: float) -> DataFrame:
        sums = [F.sum(x) for x in _X]
        products = [F.sum(F.col(_X[i]) * F.col(_X[j])) for i in range(D) for j in range(i, D)]
        got = near.groupBy("pool", "start").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("s"), F.array(*products).alias("ss"))
        return got.mapInArrow(released(_inverse(share, floors)), PARAMS)

    def starts() -> DataFrame:
        own = join_checked(rows, pooled, "key")
        middle = by_key(own.groupBy("pool").agg(F.array(*[F.percentile(x, F.lit(0.5)) for x in _X]).alias("med")))
        spread = join_checked(rows, middle, "key").groupBy("pool").agg(
            F.first("med").alias("med"), F.array(*[F.percentile(F.abs(F.col(x) - F.col("med")[i]), F.lit(0.5)) for i, x in enumerate(_X)]).alias("mad")
        )
        variance = [(F.col("mad")[i] * (1.4826 / SCALE)) ** 2 + f * f for i, f in enumerate(floors)]
        medians = spread.select(
            "pool", F.lit(0).alias("start"), F.transform("med", lambda v: v / float(SCALE)).alias("mean"),
            F.array(*[1 / variance[i] if i == j else F.lit(0.0) for i in range(D) for j in range(D)]).alias("inverse"), F.lit(float("inf")).alias("size"),
        )
        half = F.lit(2) + F.pmod(F.xxhash64(*_X), F.lit(2)).cast("int")
        parts = own.withColumn("start", F.explode(F.array(F.lit(1), half)))
        return medians.unionByName(moments(parts, 1.0).withColumn("size", F.lit(float("inf"))))

    octave = F.floor(F.log2(_distance() + 2.0**-20) * 16).cast("int")
    params, done = written(starts(), "mcd-starts", tasks), None
    for _ in range(steps):
        near = by_key(params)
        bins = join_checked(rows, near, "key").groupBy("pool", "start", octave.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # some hundred bins a pool and start
        each = Window.partitionBy("pool", "start")
        upto = bins.withColumn("cum", F.sum("n").over(each.orderBy("bin"))).withColumn("all", F.sum("n").over(each))
        half = upto.where(F.col("cum") >= F.floor((F.col("all") + D + 1) / 2)).groupBy("pool", "start").agg(F.min("bin").alias("half_bin"))
        within = written(near.join(half, ["pool", "start"]), "mcd-half", tasks)
        new = moments(join_checked(rows, within, "key").where(octave <= F.col("half_bin")), 0.5)
        old = params.select("pool", "start", *[F.col(c).alias(f"old_{c}") for c in ("mean", "inverse", "size")])
        both = written(new.join(old, ["pool", "start"]), "mcd-step", tasks)
        falls = F.col("size") < F.col("old_size") - 1e-9
        ended = both.where(~falls).select("pool", "start", *[F.col(f"old_{c}").alias(c) for c in ("mean", "inverse", "size")])
        done = ended if done is None else done.unionByName(ended)
        params = written(both.where(falls).select("pool", "start", "mean", "inverse", "size"), "mcd-params", tasks)
        if params.limit(1).count() == 0:
            break
    found = params if done is None else params.unionByName(done)
    least = found.groupBy("pool").agg(F.min(F.struct("size", "start", "mean", "inverse")).alias("m")).select("pool", "m.start", "m.mean", "m.inverse")
    last = moments(join_checked(rows, by_key(least), "key").where(_distance() <= chi2_quantile(REWEIGHT, D)), REWEIGHT)
    return by_key(last)


def _fitted(measured: DataFrame, least: int, steps: int, tasks: int) -> DataFrame:
    """(__key, __mean, __inverse) of each language and source that has an estimate. measured: __key, __lang, the statistics and the vector of each row."""
    passing = measured.where(~_failed()).select(F.col("__key").alias("key"), F.col("__lang").alias("lang"), *_X)
    counts = passing.groupBy("key").agg(F.first("lang").alias("lang"), F.count(F.lit(1)).alias("n"))
    pools = written(_pools(written(counts, "sources", tasks), least), "pools", tasks)
    sizes = measured.where(~_failed()).agg(*[F.percentile(c, F.lit(0.5)) for c in ("__n_lines", "__n_words")]).first()
    params = _estimates(passing.drop("lang"), pools, steps, floors_of(*sizes), tasks)
    return params.select(F.col("key").alias("__key"), F.col("mean").alias("__mean"), F.col("inverse").alias("__inverse"))


def _measured(docs: DataFrame, keep: list[str], lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """The columns `keep` with the statistics of each row, as a table."""
    key = F.to_json(F.struct(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")))
    rows = docs.select(*keep, key.alias("__key"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__text"))
    schema = T.StructType([f for f in rows.schema if f.name != "__text"] + [T.StructField(c, T.LongType()) for c in (*[f"__{s}" for s in STATS], "__n_lines", *_X)])
    return written(rows.mapInArrow(released(_measure), schema), "statistics", task_count(docs, 4 << 20))


def _failed() -> Column:
    return (F.col("__n_words") < MIN_WORDS) | (F.col("__n_repeat_words") * 100 > F.col("__n_words") * 50)


LIMIT = chi2_quantile(1 - CUT_PROBABILITY, D)


@foreign_kept
def judged(docs: DataFrame, keep: list[str] | None = None, steps: int = STEPS, least: int = LEAST, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs (None: all), with STATS, base_failed, distance (null where no estimate applies) and kept; columns of these names are replaced."""
    bounded_batches(docs.sparkSession)
    new = (*STATS, "base_failed", "distance", "kept")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    measured = _measured(docs, keep, lang_col, source_col, text_col)
    out = join_checked(measured, _fitted(measured, least, steps, task_count(docs)), "__key", "left")
    distance = _distance("__mean", "__inverse")
    return out.select(*keep, *[F.col(f"__{s}").alias(s) for s in STATS], _failed().alias("base_failed"), distance.alias("distance"), (~_failed() & ~F.coalesce(distance > LIMIT, F.lit(False))).alias("kept"))


def _accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that judged would keep, as they are; the distance takes the same steps as _distance, in the same order."""
    for b in batches:
        text, means, inverses = (b.column(c).to_pylist() for c in ("__text", "__mean", "__inverse"))
        ok = []
        for t, mean, inverse in zip(text, means, inverses, strict=True):
            stats = statistics(t)
            good = stats[0] >= MIN_WORDS and stats[4] * 100 <= stats[0] * 50
            if good and mean is not None:
                d, total = [x / float(SCALE) - m for x, m in zip(vector(stats), mean, strict=True)], 0.0
                for i in range(D):
                    for j in range(i, D):
                        total += d[i] * d[j] * inverse[i * D + j] * (1.0 if i == j else 2.0)
                good = total <= LIMIT
            ok.append(good)
        own = [i for i, c in enumerate(b.schema.names) if c not in ("__text", "__mean", "__inverse")]
        yield pa.RecordBatch.from_arrays([b.column(i) for i in own], names=[b.schema.names[i] for i in own]).filter(pa.array(ok, pa.bool_()))


@foreign_kept
def reject_outliers(docs: DataFrame, steps: int = STEPS, least: int = LEAST, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs without the rows that are rejected; same columns. Statistics are written alone and taken anew from the texts in the end, so no text is stored in between."""
    bounded_batches(docs.sparkSession)
    measured = _measured(docs, [], lang_col, source_col, text_col)
    params = _fitted(measured, least, steps, task_count(docs)).withColumnsRenamed({"__key": "__k"})
    rows = docs.select("*", F.col(text_col).alias("__text"), F.to_json(F.struct(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))).alias("__own"))
    rows = join_checked(rows, params, F.col("__own") == F.col("__k"), "left").drop("__own", "__k")
    return rows.mapInArrow(released(_accepted), docs.schema)
