"""Text expressions: content ids, normalisation, filters, prompts. All are built-in functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and types that make no useful vertex.
LOW_NAMES = (
    "he", "she", "they", "them", "him", "her", "his", "their", "hers", "theirs", "someone", "some one", "somebody", "something",
    "one of us", "one", "it", "its", "this", "that", "these", "those",
)
LOW_TYPES = ("pronoun", "reference", "generic", "other")
#: Patterns of the normalisation, with \w spelt for Unicode.
ARTICLE, PAREN, POSSESSIVE, SPACES = r"^(?:the|an|a)\s+", r"\s+\([^)]*\)", r"(?:'s|’s)$", r"\s{2,}"
EDGES = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
PUNCTUATION = r"""[!-/:-@\[-`{-~]"""


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def content_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(text))


def normalize_name(text: Column) -> Column:
    """One pass; it is not idempotent, and mentions take several."""
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    t = F.replace(F.regexp_replace(t, ARTICLE, ""), F.lit("(s)"), F.lit(""))
    t = F.replace(F.replace(F.regexp_replace(t, PAREN, ""), F.lit("-"), F.lit(" ")), F.lit("/"), F.lit(" / "))
    t = F.regexp_replace(F.regexp_replace(t, POSSESSIVE, ""), EDGES, "")
    return strip(F.regexp_replace(t, SPACES, " "))


def normalize_type(kind: Column) -> Column:
    t = F.lower(strip(F.coalesce(F.nullif(kind, F.lit("")), F.lit("entity"))))
    t = F.regexp_replace(F.replace(F.replace(t, F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_")), SPACES, "_")
    # a blank type is "entity" as well
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("entity"))


def normalize_description(text: Column, fallback: Column | None = None) -> Column:
    fallback = F.lit("") if fallback is None else fallback
    t = F.lower(strip(F.coalesce(F.nullif(text, F.lit("")), fallback, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(t, r"^[ .;,:]+|[ .;,:]+$", ""), SPACES, " ")


def embedding_text(name: Column, description: Column) -> Column:
    n, d = normalize_name(name), normalize_description(description)
    return F.when(d != "", F.concat(n, F.lit(": "), d)).otherwise(n)


def choose_description(field: Column, attribute: Column, listed: Column) -> Column:
    """The first of: the field, a string attribute, the first item of a list that isn't blank."""
    return F.coalesce(F.nullif(field, F.lit("")), attribute, F.get(F.filter(listed, lambda x: strip(x) != ""), F.lit(0)))


def mention_id(passage: Column, unit: Column, name: Column, start: Column, end: Column) -> Column:
    parts = [passage, unit, name, *[F.coalesce(x.cast("string"), F.lit("None")) for x in (start, end)]]
    return content_id("men-", F.concat_ws("|", *parts))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def is_low_value(name: Column, kind: Column, description: Column) -> Column:
    letters = F.length(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))
    blank = lambda c: c.isNull() | (c == "")
    return blank(name) | kind.isin(*LOW_TYPES) | name.isin(*LOW_NAMES) | (F.length(name) < 3) | (word_count(name) > 8) | (letters < 3) | blank(description)


def normalize_answer(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return strip(F.regexp_replace(F.regexp_replace(t, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def contains_answer(predicted: Column, gold: Column) -> Column:
    """1 when the normalised gold answer is within the normalised prediction; 0 when either is blank."""
    blank = (F.coalesce(strip(predicted), F.lit("")) == "") | (F.coalesce(strip(gold), F.lit("")) == "")
    return F.when(blank, 0).otherwise(F.contains(normalize_answer(predicted), normalize_answer(gold)).cast("int"))


def extract_answer(text: Column) -> Column:
    """What stands between the first and the second "Answer:"; the whole text without one."""
    parts = F.split(text, "Answer:")
    return F.when(F.size(parts) > 1, strip(F.get(parts, F.lit(1)))).otherwise(text)


def reader_prompt(passages: Column, question: Column) -> Column:
    """passages: their texts in order."""
    body = F.array_join(F.transform(passages, lambda p: F.concat(p, F.lit("\n"))), "")
    return F.concat(body, F.lit("Question: "), question, F.lit("\n Thought: "))


#: What a reranker, a reader, a planner and a judge are told.
RERANK_TASK = "Does the document hold evidence for the multi-hop question, as its answer or as a step towards it?"
READER_TASK = "Read the passages closely and answer the question. Begin with \"Thought: \" and reason step by step; end with \"Answer: \" and nothing but the answer, in as few words as will do."
PLANNER_TASK = "Split the question into the fewest sub-queries that retrieval needs, in the order in which they build on each other. Answer with one JSON object: is_complex, reasoning, sub_queries (id, query, purpose, answer_type) and synthesis_instruction."
JUDGE_TASK = "You judge answers."
#: A fixed value: what one public family of embedding models wants before a question.
QUESTION_PREFIX = "Represent this sentence for searching relevant passages: "


def chat(system: str, user: Column) -> Column:
    """A system and a user message as JSON, as chat models take them."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.array(said("system", F.lit(system)), said("user", user)))


def judge_prompt(predicted: Column, gold: Column) -> Column:
    """The judge's question about a predicted answer; the reply is read by judged_correct."""
    rules = "It is correct if it holds the gold answer's key information, is factually in keeping with it and contradicts none of it."
    return F.concat(F.lit("Is this answer correct?\nAnswer: "), F.coalesce(predicted, F.lit("")), F.lit("\nGold answer: "), F.coalesce(gold, F.lit("")), F.lit(f"\n{rules}\nReply with one word, correct or incorrect.\n"))


def rerank_pair(instruction: str, query: Column, passage: Column, most: int | None = None) -> Column:
    """A pair as a reranker reads it, whole (a model's budget is in tokens, see framing). With `most`, of the passage what goes beyond so many characters in all is left off."""
    if most is not None:
        passage = F.left(passage, F.greatest(F.lit(most) - F.length(query), F.lit(0)))
    return F.concat(F.lit(f"<Instruct>: {instruction}\n<Query>: "), query, F.lit("\n<Document>: "), passage)


def index_prefix(text: Column) -> Column:
    """The number before a colon at the beginning, or null."""
    return F.nullif(F.regexp_extract(strip(text), r"^(\d+):", 1), F.lit("")).cast("long")


def tokens(text: Column) -> Column:
    """Default tokens: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def sentences(text: Column, longer_than: int = 10) -> Column:
    """Default sentences: cut after . ! or ? before white space; those of more than so many characters, trimmed, in order."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])\s+", "$1\x1f"), "\x1f")
    return F.filter(F.transform(cut, strip), lambda s: F.length(s) > longer_than)


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name, r"\s+"), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = name_tokens(a), name_tokens(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of the longer name that the shorter one, if within it, makes up."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(F.contains(a, b) | F.contains(b, a), short / F.nullif(long, F.lit(0))).otherwise(0.0)
