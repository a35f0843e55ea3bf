"""A benchmark run: corpora and questions in, one index with all corpora apart, predictions and their evaluation out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import Config
from skein.core import written
from skein.corpora import Corpora
from skein.engine import Engine
from skein.functions import providers, scope
from skein.plans import qa
from skein.sources import files

Reader = Callable[[Column], Column]


def _numbered(questions: DataFrame) -> DataFrame:
    """questions with query_id, which is their id, or where there is none the digest of the question."""
    key = F.coalesce(F.col("id"), F.md5("question")) if "id" in questions.columns else F.md5("question")
    return questions.withColumn("query_id", key)


def run_corpora(
    spark: SparkSession, corpus_path: str, questions_path: str, folder: str, config: Config | None = None, reader: Reader = providers.extractive_answer,
    entry: str | None = None, types: list[str] | None = None, limit: int | None = None, answer: bool = True, **engine,
) -> DataFrame | None:
    """Records of answers to the questions about each corpus, written to folder/predictions; None without answering. All corpora are indexed and asked in one plan, below folder/index.

    corpus_path has objects of corpus_name and context; entry, types and limit choose among corpora and questions.
    """
    corpora = files.read_corpus(spark, files.required(spark, corpus_path))
    asked = files.select_questions(files.read_questions(spark, files.required(spark, questions_path)), [entry] if entry else None, types, limit)
    asked = written(_numbered(asked), "asked")
    corpora = written(files.corpora_for(asked, corpora, entry), "corpora")
    e = Corpora(spark, f"{folder.rstrip('/')}/index", config, **engine)
    e.index_corpus(corpora)
    if not answer:
        return None
    asked = asked.join(corpora.select(F.col("corpus_name").alias("source")).distinct(), "source", "left_semi")
    asked = written(asked.withColumn("query_id", scope.scoped(F.col("source"), F.col("query_id"))), "asked-of")  # one question may be asked of two corpora
    got = e.rag_qa(asked.select("query_id", "question", F.col("source").alias("corpus_name")), reader).select("query_id", "answer", F.col("passages").alias("context"))
    found = files.official_records(got, asked.withColumn("id", F.col("query_id"))).withColumn("id", scope.bare(F.col("id")))
    found = written(found, "answers")
    files.write_json(found, f"{folder.rstrip('/')}/predictions")
    return found


def run_chunks(spark: SparkSession, data: str, folder: str, config: Config | None = None, reader: Reader = providers.extractive_answer, judge: Reader | None = None, limit: int | None = None, **engine) -> DataFrame:
    """Predictions for data/questions.json over the passages of data/chunks.json, written with their scores to folder/predictions, and the means to folder/evaluation."""
    files.required(spark, data)
    asked = files.read_questions(spark, f"{data}/questions.json")
    asked = _numbered(asked)
    asked = written(asked if limit is None else asked.orderBy("query_id", "question").limit(limit), "asked")
    e = Engine(spark, f"{folder.rstrip('/')}/index", config, **engine)
    e.index(files.read_chunks(spark, f"{data}/chunks.json"))
    got = e.rag_qa(asked.select("query_id", "question"), reader)
    both = got.join(asked.select("query_id", F.col("answer").alias("gold_answer")), "query_id")
    made = both.select("question", F.col("answer").alias("pred_answer"), "gold_answer", F.col("passages").alias("sorted_passage"), F.col("scores").alias("sorted_passage_scores"))
    rows, means = qa.evaluate(written(made, "predictions"), judge)
    files.write_json(rows, f"{folder.rstrip('/')}/predictions")
    files.write_json(means.coalesce(1), f"{folder.rstrip('/')}/evaluation")
    return rows
