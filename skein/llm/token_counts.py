"""Token counts through a digest cache: normalised content and tokenizer version are joined to stored counts; only distinct
misses are encoded, and they are appended to the cache.

Normalised content is the text itself with null as empty, as a count depends on each character. The cache is a Parquet table
(content digest, tokenizer digest, n_tokens) in any store that Spark writes; an append is one Spark commit. Copies are told from
the digests alone: a text is read where its row is the one that stands for its digest, so texts move only where the digests that
repeat outgrow a broadcast. Digests of many rows are salted in the last join, so that no task gets all rows of one text.

Defined cases: null and empty texts have 0 bytes and 0 tokens; each row gets its count, repeated rows and null ids included;
copies of a text are encoded once (once a task, where they share the id too or have none); further columns stay, and those named
like new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_batches, foreign_kept, is_small, join_checked, released, task_count, tokenizer_path, work_path, written
from .tokenize import encoder, in_slices, version_digest

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Rows of one digest from which it is salted, and in how many parts.
HOT_ROWS, SALT = 10_000, 64


def _count(path: str, tokenizer_digest: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path), set()
        for b in batches:
            digests = b.column("content_digest").to_pylist()
            some = [i for i, d in enumerate(digests) if d not in seen and (b.column("repeats")[i].as_py() is False or not seen.add(d))]  # only digests that repeat are remembered
            texts = b.column("content").take(pa.array(some, pa.int64())).to_pylist()
            counts = [len(x) // 4 for i, j in in_slices(texts) for x in enc.encode(texts[i:j])]
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in some], pa.binary()), pa.array([tokenizer_digest] * len(some), pa.string()), pa.array(counts, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    return run


def open_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache table, made empty where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], CACHE_SCHEMA).coalesce(1).write.parquet(cache)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def _salted(counts: DataFrame, hot: DataFrame) -> DataFrame:
    """counts with a row for each salt of a hot digest, and one for all others."""
    parts = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    both = join_checked(counts, hot.select(F.col("content_digest").alias("__hot")), F.col("__key") == F.col("__hot"), "left")
    return both.select("__key", "__tokens", F.explode(parts).alias("__part"))


@foreign_kept
def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", cache: str | None = None, limit: int = 512, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit. tokenizer: a vocabulary's name or path. cache: the cache table's path (None: a new one)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = tokenizer if "/" in tokenizer else tokenizer_path(tokenizer)
    version = version_digest(path)
    cache = cache or work_path(spark, "token-cache")
    content = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))
    stored = open_cache(spark, cache).where(F.col("tokenizer_digest") == version).select("content_digest").distinct()
    digests = docs.select(F.col(id_col).alias("__id"), digest.alias("content_digest")).groupBy("content_digest").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first"))
    tasks = task_count(docs)
    digests = written(digests, "digests", tasks)
    hits, missing = written(digests.join(stored, "content_digest", "left_semi").select("content_digest"), "hits", tasks), digests.join(stored, "content_digest", "left_anti")
    repeated = written(missing.where("n > 1").select(F.col("content_digest").alias("__d"), "first"), "repeated", tasks)
    hot = written(digests.where(F.col("n") >= HOT_ROWS).select("content_digest"), "hot", tasks)
    texts = docs.select(F.col(id_col).alias("__id"), content.alias("content"), digest.alias("content_digest"))
    if not is_small(hits) and is_small(few := written(missing.select("content_digest"), "misses", tasks)):
        texts = texts.join(F.broadcast(few), "content_digest", "left_semi")
    else:
        texts = join_checked(texts, hits, "content_digest", "left_anti")
    texts = join_checked(texts, repeated, F.col("content_digest") == F.col("__d"), "left").where(F.col("__d").isNull() | F.col("__id").eqNullSafe(F.col("first")))
    misses = texts.select("content", "content_digest", F.col("__d").isNotNull().alias("repeats"))
    misses.mapInArrow(released(_count(path, version)), CACHE_SCHEMA).repartition(tasks).write.mode("append").parquet(cache)
    counts = open_cache(spark, cache).where(F.col("tokenizer_digest") == version).groupBy(F.col("content_digest").alias("__key")).agg(F.min("n_tokens").alias("__tokens"))
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    keyed = docs.select(*kept, digest.alias("__digest"), F.octet_length(content).cast("long").alias("n_bytes"))
    keyed = join_checked(keyed, hot.select(F.col("content_digest").alias("__salted")), F.col("__digest") == F.col("__salted"), "left")
    told = [F.col(f"`{c}`") for c, k in keyed.dtypes if c != text_col and not k.startswith("map")]  # of a row, so that a task that runs anew deals it as before
    keyed = keyed.withColumn("__salt", F.when(F.col("__salted").isNotNull(), F.pmod(F.xxhash64(*told), F.lit(SALT)).cast("int")).otherwise(0))
    out = keyed.join(_salted(counts, hot), (F.col("__digest") == F.col("__key")) & (F.col("__salt") == F.col("__part")), "left")
    return out.select(*kept, "n_bytes", F.col("__tokens").alias("n_tokens"), (F.col("__tokens") > limit).alias("over_limit"))
