"""Answers from retrieved passages, and their evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import providers
from skein.functions import text as X


def prompts(results: DataFrame, passages: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, question, passages, scores, prompt): texts are joined after the cut, in rank order."""
    texts = results.join(passages.select("passage_id", "text"), "passage_id")
    lists = texts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "score"))).alias("r"))
    both = questions.select("query_id", "question").join(lists, "query_id")
    listed = both.select("query_id", "question", F.transform("r", lambda x: x["text"]).alias("passages"), F.transform("r", lambda x: x["score"]).alias("scores"))
    return listed.withColumn("prompt", X.reader_prompt(F.col("passages"), F.col("question")))


def answers(prompted: DataFrame, reader: Callable[[Column], Column] = providers.extractive_answer) -> DataFrame:
    return prompted.withColumn("response", reader(F.col("prompt"))).withColumn("answer", X.extract_answer(F.col("response")))


def contain_scores(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("contain_accuracy", X.contains_answer(F.col("pred_answer"), F.col("gold_answer")))


def judged(predictions: DataFrame, judge: Callable[[Column], Column]) -> DataFrame:
    """predictions with llm_accuracy. judge: a column of prompts to a column of replies, as providers.chat_provider gives."""
    reply = judge(X.chat(X.JUDGE_TASK, X.judge_prompt(F.col("pred_answer"), F.col("gold_answer"))))
    return predictions.withColumn("llm_accuracy", providers.judged_correct(reply))


def evaluate(predictions: DataFrame, judge: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(per question, means) of the containing answers and, with a judge, of those it calls correct. The means of no questions are null."""
    rows = contain_scores(predictions)
    if judge is not None:
        rows = judged(rows, judge)
    means = [F.avg(c).alias(c) for c in ("llm_accuracy", "contain_accuracy") if c in rows.columns]
    return rows, rows.agg(*means)


def messages(prompted: DataFrame, task: str = X.READER_TASK) -> DataFrame:
    """prompted with the reader's system and user messages as JSON, for readers that take chats."""
    return prompted.withColumn("messages", X.chat(task, F.col("prompt")))
