"""Corpora, questions, chunks and predictions as JSON, and the newest snapshot of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(corpus_name, context): one JSON object or an array of them."""
    return spark.read.schema(schema.CORPUS).option("multiLine", True).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.QUESTIONS).option("multiLine", True).json(path)


def question_types(questions: DataFrame) -> DataFrame:
    return questions.groupBy(F.coalesce("question_type", F.lit("unknown")).alias("question_type")).agg(F.count(F.lit(1)).alias("n"))


def select_questions(questions: DataFrame, sources: list[str] | None = None, types: list[str] | None = None, limit: int | None = None, order: str = "id") -> DataFrame:
    """Filters by source and type, then the first `limit` in order."""
    out = questions
    if sources is not None:
        out = out.where(F.col("source").isin(*sources))
    if types:
        out = out.where(F.col("question_type").isin(*types))
    return out.orderBy(order).limit(limit) if limit is not None else out


def by_source(questions: DataFrame) -> DataFrame:
    """(source, n, questions): the questions of each source in order, sources in order."""
    q = questions.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("id", "question"))).alias("questions"))
    return q.select("source", "n", F.transform("questions", lambda x: x["question"]).alias("questions")).orderBy("source")


def numbered_passages(chunks: DataFrame, list_col: str = "chunks", *keep: str) -> DataFrame:
    """(keep, pos, text): each chunk with its number and a colon before it."""
    rows = chunks.select(*keep, F.posexplode(list_col).alias("pos", "chunk"))
    return rows.select(*keep, "pos", F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("chunk")).alias("text"))


def shared_sources(questions: DataFrame, corpora: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources with a corpus, sources without one)."""
    asked, there = questions.select(F.col("source").alias("corpus_name")).distinct(), corpora.select("corpus_name").distinct()
    return asked.intersect(there), asked.join(there, "corpus_name", "left_anti")


def newest_snapshot(spark: SparkSession, folder: str) -> str:
    """The path of the entry of a folder that was changed last, in any file system Spark reads; ties go to the larger name."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = [(s.getModificationTime(), s.getPath().toString()) for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    if not found:
        raise FileNotFoundError(f"no snapshot in {folder}")
    return max(found)[1]


def official_records(results: DataFrame, questions: DataFrame) -> DataFrame:
    """The eight fields of a prediction record; results: (query_id, answer, context list)."""
    q = questions.select(F.col("id"), "question", "source", "evidence", "question_type", "answer")
    r = results.select(F.col("query_id").alias("id"), F.col("answer").alias("generated_answer"), "context")
    none = F.array().cast("array<string>")
    return q.join(r, "id").select(
        "id", "question", "source", F.coalesce("context", none).alias("context"), F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce("question_type", F.lit("unknown")).alias("question_type"),
        F.coalesce("generated_answer", F.lit("")).alias("generated_answer"), F.coalesce("answer", F.lit("")).alias("ground_truth"),
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(pos, text): the passages of a file with one JSON array of strings, each with its number and a colon before it."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("chunks"))
    return numbered_passages(whole, "chunks")


def required(spark: SparkSession, path: str) -> str:
    """The path, if something is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"no data set at {path}")
    return path


def corpora_for(questions: DataFrame, corpora: DataFrame, entry: str | None = None) -> DataFrame:
    """The corpora that questions ask about; with entry that one alone, which must be there."""
    if entry is None:
        return corpora.join(questions.select(F.col("source").alias("corpus_name")).distinct(), "corpus_name", "left_semi")
    found = corpora.where(F.col("corpus_name") == entry)
    if found.limit(1).count() == 0:
        raise ValueError(f"there is no corpus entry {entry!r}")
    return found


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.PREDICTIONS).json(path)
