"""Mention records of passages and of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.core import written
from skein.functions import text as X


def named(found: DataFrame) -> DataFrame:
    """Extractions with their names, types and descriptions normalised, without low-value ones."""
    surface = X.strip(F.coalesce("surface_text", F.lit("")))
    others = [c for c in found.columns if c not in ("surface_text", "entity_type", "description")]
    rows = found.select(
        *others, surface.alias("surface_text"), X.normalize_name(surface).alias("normalized_name"), X.normalize_type(F.col("entity_type")).alias("entity_type"),
        X.normalize_description(F.col("description"), surface).alias("description"),
    )
    return rows.where(~X.is_low_value(F.col("normalized_name"), F.col("entity_type"), F.col("description")))


def mention_records(found: DataFrame) -> DataFrame:
    """Records of extractions (passage_id, su_id, surface_text, entity_type, description, char_start, char_end), without low-value ones; those with a normalized_name are as `named` gives them.

    Within a unit a name, type and description occur once; the first place stays.
    """
    rows = found if "normalized_name" in found.columns else named(found)
    rows = rows.withColumn("grounded", F.col("char_start").isNotNull())
    key = ["passage_id", "su_id", "normalized_name", "entity_type", "description"]
    # dealt by key first: few rows share one, so that combining them before the shuffle would only sort them once more
    rows = rows.repartition(*key).groupBy(*key).agg(F.min(F.struct(F.col("char_start").isNull().alias("z"), "char_start", "char_end", "surface_text", "grounded")).alias("m"))
    rows = rows.select(*key, "m.surface_text", "m.char_start", "m.char_end", "m.grounded")
    return rows.withColumn("mention_id", X.mention_id(*[F.col(c) for c in ("passage_id", "su_id", "normalized_name", "char_start", "char_end")]))


def query_mentions(found: DataFrame) -> DataFrame:
    """(query_id, ord, surface_text, normalized_name, entity_type, description, embedding_text) of extractions with query_id and ord, once each."""
    as_units = found.withColumn("passage_id", F.col("query_id")).withColumn("su_id", F.col("query_id")).withColumn("char_start", F.col("ord")).withColumn("char_end", F.col("ord"))
    rows = mention_records(as_units)
    return rows.select(F.col("passage_id").alias("query_id"), F.col("char_start").alias("ord"), "surface_text", "normalized_name", "entity_type", "description", X.embedding_text(F.col("normalized_name"), F.col("description")).alias("embedding_text"))


def _pieces(text: Column) -> Column:
    """A text's words, cut at everything else, in lower case with a space between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def known_names(questions: DataFrame, entities: DataFrame, within: str | None = None) -> DataFrame:
    """Extractions (query_id, ord, surface_text, entity_type, description) of the entities' names that a question holds, whatever their number of words.

    A question's runs of words are made for those numbers of words that a stored name has. With `within`, a column
    of both, names count for the questions with their own value there.
    """
    scope = [] if within is None else [within]
    names = entities.select(*scope, F.explode("aliases").alias("name"), "entity_type")
    names = names.withColumn("run", _pieces(F.col("name"))).where("run <> ''").groupBy(*scope, "run").agg(F.min("entity_type").alias("entity_type"))
    names = written(names.withColumn("n_words", F.size(F.split("run", " "))), "names")
    lengths = sorted(r[0] for r in names.select("n_words").distinct().collect())  # as many as names differ in length
    words = questions.select("query_id", *scope, F.split(_pieces(F.col("question")), " ").alias("w"))
    at = words.withColumn("n", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"))).where("n <= size(w)")
    at = at.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    runs = at.select("query_id", *scope, (F.col("i") * (max(lengths, default=0) + 1) + F.col("n")).alias("at"), F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("surface_text"))
    runs = runs.where("surface_text <> ''").groupBy("query_id", *scope, "surface_text").agg(F.min("at").alias("ord"))
    both = runs.join(names.withColumnRenamed("run", "surface_text"), [*scope, "surface_text"])
    return both.select("query_id", "ord", "surface_text", "entity_type", F.col("surface_text").alias("description"))
