"""Query plans from a planner's answers: parsing, defaults and fallbacks, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import PLANNER_TASK, chat, strip

#: What stands in where a planner says nothing.
PURPOSE, DIRECT, OTHER = "gather supporting evidence", "answer directly", "other"
DIRECT_SYNTHESIS = "answer directly from the best supporting evidence"
SYNTHESIS = "combine the sub-query evidence to answer the original question"
REASONING, EMPTY, NOT_JSON = "planner generated a query plan", "empty query", "planner returned non-JSON output"
_SUB = "array<struct<id:string,query:string,purpose:string,answer_type:string>>"
_ANSWER = f"struct<is_complex:boolean,reasoning:string,sub_queries:{_SUB},synthesis_instruction:string>"


def strip_fences(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    open_at = F.regexp_replace(t, r"^```(?:json)?\s*", "")
    return strip(F.when(F.startswith(t, F.lit("```")), F.regexp_replace(open_at, r"\s*```$", "")).otherwise(t))


def json_object(text: Column) -> Column:
    """The JSON object of an answer as text: the whole, else from the first brace to the last; null if neither parses."""
    t = strip_fences(text)
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    whole = lambda x: F.when(F.startswith(strip(x), F.lit("{")) & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(whole(t), whole(inner))


def request(query: Column, most: int, context: Column | None = None) -> Column:
    """The user message of a planner as JSON; no context field where there is none."""
    fields = [query.alias("query"), F.lit(max(1, most)).alias("max_subqueries")]
    if context is not None:
        fields.append(F.nullif(context, F.lit("")).alias("extra_context"))
    return F.to_json(F.struct(*fields))


def messages(query: Column, most: int, context: Column | None = None) -> Column:
    """The planner's system and user messages as JSON."""
    return chat(PLANNER_TASK, request(query, most, context))


def _sub(i, query, purpose, kind) -> Column:
    return F.struct(i.alias("id"), query.alias("query"), purpose.alias("purpose"), kind.alias("answer_type"))


def plan(query: Column, response: Column, most: int = 5) -> Column:
    """The plan of a question as a struct, from a planner's answer."""
    q = strip(F.coalesce(query, F.lit("")))
    parsed = F.from_json(json_object(response), _ANSWER)
    filled = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))

    def one(item, i):
        number = F.concat(F.lit("sq"), (i + 1).cast("string"))
        return _sub(F.coalesce(F.nullif(item["id"], F.lit("")), number), strip(F.coalesce(item["query"], F.lit(""))), strip(filled(item["purpose"], PURPOSE)), strip(filled(item["answer_type"], OTHER)))

    direct = F.array(_sub(F.lit("sq1"), q, F.lit(DIRECT), F.lit(OTHER)))
    subs = F.filter(F.transform(F.coalesce(parsed["sub_queries"], F.array().cast(_SUB)), one), lambda s: s["query"] != "")
    subs = F.slice(F.when(F.size(subs) > 0, subs).otherwise(direct), 1, max(1, most))

    def made(complex_, reasoning, sub_queries, synthesis):
        return F.struct(q.alias("original_query"), complex_.alias("is_complex"), reasoning.alias("reasoning"), sub_queries.alias("sub_queries"), synthesis.alias("synthesis_instruction"))

    fallback = lambda why: made(F.lit(False), F.lit(why), direct, F.lit(DIRECT_SYNTHESIS))
    said = lambda name, d: F.coalesce(F.nullif(strip(F.coalesce(parsed[name], F.lit(""))), F.lit("")), F.lit(d))
    whole = made(F.coalesce(parsed["is_complex"], F.size(subs) > 1), said("reasoning", REASONING), subs, said("synthesis_instruction", SYNTHESIS))
    return F.when(q == "", fallback(EMPTY)).when(json_object(response).isNull(), fallback(NOT_JSON)).otherwise(whole)


def sub_query_gates(plans: DataFrame, embed) -> DataFrame:
    """(query_id, embedding): a gate for each sub-query, for expand(gates=...)."""
    rows = plans.select("query_id", F.explode("plan.sub_queries").alias("s"))
    return rows.select("query_id", embed(F.col("s.query")).alias("embedding"))
