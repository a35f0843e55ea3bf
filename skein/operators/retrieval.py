"""Retrieval for all questions at once: seeds, gated expansion hop by hop, fusion with dense similarity, and reranking.

Scores that order something are rounded to nine digits, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.config import Config
from skein.core import is_small, join_checked, written
from skein.functions.vectors import dot

from .ordering import in_order
from .similarity import Shared, nearest, with_vectors


def ranked(df: DataFrame, k: int | None, score: str, ties: str, by: str = "query_id") -> DataFrame:
    """df with rank by score within each `by`, ties by another column. The k best come from a window, whose group limit leaves k of a task before the shuffle; a full ranking from ranges, as one group may be as long as the table."""
    best = [F.round(score, 9).desc(), F.col(ties)]
    if k is None:
        return in_order(df, [by], best)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*best))).where(F.col("rank") <= k)


def seed_entities(mentions: DataFrame, entities: DataFrame | Shared, least: float | None = None, within: str | None = None) -> DataFrame:
    """(query_id, ord, entity_id, score): each mention (query_id, ord, embedding) goes to its nearest entity, whatever its score; with `within`, of those with its own value there."""
    scope = [] if within is None else [within]
    m = mentions.withColumn("m", F.concat_ws("|", "query_id", F.lpad(F.col("ord").cast("string"), 9, "0")))
    near = nearest(entities, m.select("m", *scope, "embedding"), 1, "entity_id", "m", within)
    out = near.join(m.select("m", "query_id", "ord"), "m").select("query_id", "ord", "entity_id", "score")
    return out if least is None else out.where(F.col("score") >= least)


def seed_metadata(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """seeds (query_id, ord, entity_id, score) with canonical_name and entity_type of nodes; an entity without a record is named by its id."""
    own = nodes.select(F.col("entity_id").alias("__node"), "canonical_name", "entity_type")
    both = seeds.join(own, F.col("entity_id") == F.col("__node"), "left")
    return both.select("query_id", "ord", "entity_id", "score", F.coalesce("canonical_name", F.col("entity_id").cast("string")).alias("canonical_name"), "entity_type")


def conductance(similarity: Column, floor: float, gamma: float) -> Column:
    return F.pow(F.greatest(F.greatest(similarity, F.lit(0.0)) - floor, F.lit(0.0)) / max(1.0 - floor, 1e-8), F.lit(gamma))


def unit_signal(front: DataFrame, inc: DataFrame) -> DataFrame:
    """(query_id, su_id, signal): the largest score of the frontier's entities (query_id, entity_id, score; cheap to count) in each unit. Repeated incidences change nothing."""
    return join_checked(inc, front.where("score > 0"), "entity_id").groupBy("query_id", "su_id").agg(F.max("score").alias("signal"))


def gate_counts(sims: DataFrame, floor: float, gamma: float) -> DataFrame:
    """(query_id, n_active, n_suppressed) of units by their similarity (query_id, score)."""
    w = conductance(F.col("score"), floor, gamma)
    return sims.groupBy("query_id").agg(F.count_if(w > 0).alias("n_active"), F.count_if(w <= 0).alias("n_suppressed"))


def total_activation(active: DataFrame) -> DataFrame:
    return active.groupBy("query_id").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("n"))


def over_maximum(df: DataFrame, score: str, name: str, by: str = "query_id", most: DataFrame | None = None) -> DataFrame:
    """The score over its largest in the group, where that is positive. Only maxima are shuffled, as long as they are few.

    most: (by, score) of the largest ones, where they are known for less than df costs.
    """
    most = most if most is not None else df.groupBy(by).agg(F.max(score).alias(score))
    most = written(most.select(F.col(by).alias("__by"), F.col(score).alias("__most")), "maxima")
    both = join_checked(df, most, F.col(by) == F.col("__by"))
    return both.withColumn(name, F.when(F.col("__most") > 0, F.col(score) / F.col("__most")).otherwise(F.col(score))).drop("__by", "__most")


def expand(inc: DataFrame, units: DataFrame | Shared, questions: DataFrame, seeds: DataFrame, entities: DataFrame | Shared | None = None, config: Config | None = None, gates: DataFrame | None = None) -> DataFrame:
    """(query_id, entity_id, score, hop, is_seed) that spreads from the seeds over the incidence (entity_id, su_id).

    Units are gated by their similarity to the question, which is computed for reached units alone; with `gates` (query_id,
    embedding), the largest similarity to any of a question's gates counts. With entities (entity_id, embedding), the question
    is steered to what was found after each hop. Of two mentions of one entity the later one's score holds.

    The frontier is broadcast while it is small, so that the incidence isn't shuffled for it; beyond that, and for the bridge, the
    incidence is shuffled by its key alone, without distinct or sort. Repeated incidences change nothing.
    """
    c = config or Config()
    start = seeds.groupBy("query_id", "entity_id").agg(F.max_by("score", "ord").alias("score"))
    active = new = written(start.select("query_id", "entity_id", F.col("score").cast("double").alias("score"), F.lit(0).alias("hop"), F.lit(True).alias("is_seed")), "active")
    original = questions.select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    if gates is not None:
        original = gates.select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    now = written(original, "questions")
    for hop in range(1, c.max_hops + 1):
        signal = unit_signal(new.select("query_id", "entity_id", "score"), inc)
        reached = join_checked(with_vectors(signal, units, "su_id", "u"), now, "query_id")
        reached = reached.groupBy("query_id", "su_id").agg(F.max("signal").alias("signal"), F.max(dot(F.col("u"), F.col("q"))).alias("sim"))
        bridge = reached.select("query_id", "su_id", (F.col("signal") * conductance(F.round("sim", 9), c.conductance_floor, c.conductance_gamma)).alias("bridge")).where("bridge > 0")
        bridge = written(bridge, "bridge")
        met = inc.join(F.broadcast(bridge) if is_small(bridge) else bridge.hint("shuffle_hash"), "su_id")  # a unit has a row a question at most
        found = met.groupBy("query_id", "entity_id").agg(F.max("bridge").alias("score"))
        found = found.join(active.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_anti")
        new = ranked(found, c.hop_top_k, "score", "entity_id").select("query_id", "entity_id", (F.col("score") * c.hop_decay**hop).alias("score"), F.lit(hop).alias("hop"), F.lit(False).alias("is_seed"))
        new = written(new, "hop")
        active = active.unionByName(new)
        if entities is not None and c.steering_alpha < 1 and hop < c.max_hops:
            now = written(steered(now, original, active, new, entities, c), "questions")
    return active


def steered(now: DataFrame, original: DataFrame, active: DataFrame, new: DataFrame, entities: DataFrame | Shared, c: Config) -> DataFrame:
    """Questions drawn to the mean of their best found entities; those that found nothing in this hop stay."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "hop", "entity_id")
    best = active.where(~F.col("is_seed")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= c.steering_top_k)
    best = best.join(new.select("query_id").distinct(), "query_id", "left_semi")
    places = with_vectors(best.select("query_id", "entity_id"), entities, "entity_id", "embedding").select("query_id", F.posexplode("embedding").alias("i", "x"))
    mean = places.groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    mean = mean.withColumn("n", F.sqrt(dot(F.col("m"), F.col("m")))).where("n > 1e-8")
    a = c.steering_alpha
    mixed = original.join(mean, "query_id").withColumn("n", F.col("n")).select("query_id", F.zip_with("q", F.transform("m", lambda x: x / F.col("n")), lambda q, m: q * a + m * (1 - a)).alias("s"))
    mixed = mixed.withColumn("len", F.sqrt(dot(F.col("s"), F.col("s"))) + 1e-8).select("query_id", F.transform("s", lambda x: x / F.col("len")).alias("new_q"))
    return now.join(mixed, "query_id", "left").select("query_id", F.coalesce("new_q", "q").alias("q"))


def dense(passages: DataFrame | Shared, questions: DataFrame, k: int | None, within: str | None = None) -> DataFrame:
    """(query_id, rank, passage_id, score) by cosine alone; with `within`, of the passages with the question's own value there."""
    return nearest(passages, questions, k, "passage_id", within=within)


#: Weights (passage_id, entity_id, ...) and idf (entity_id, idf) of some entities (entity_id) alone.
WeightsOf = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def fuse(active: DataFrame, weights: DataFrame | WeightsOf, idf: DataFrame | None, passages: DataFrame | Shared, questions: DataFrame, lam: float, k: int | None, within: str | None = None) -> DataFrame:
    """(query_id, rank, passage_id, score) of questions with seeds: dense similarity and entity coverage, each over its maximum.

    Coverage is the idf-weighted activation of a passage's entities over all activation. Without coverage a passage is among the
    k best only if it is among the k nearest, so just those and the covered passages are scored, and all pairs only where
    all are wanted (k is None). Weights may be a function (then idf is None), which is asked for those of the active entities.
    """
    total = active.groupBy("query_id").agg(F.sum("score").alias("total"))
    if not isinstance(weights, DataFrame):
        weights, idf = weights(written(active.select("entity_id").distinct(), "wanted"))
    parts = active.join(idf.select("entity_id", "idf"), "entity_id", "left").select("query_id", "entity_id", (F.col("score") * F.coalesce("idf", F.lit(1.0))).alias("part"))
    found = join_checked(weights.select("passage_id", "entity_id"), written(parts, "parts"), "entity_id")
    cover = found.groupBy("query_id", "passage_id").agg(F.sum("part").alias("c")).join(total, "query_id")
    cover = written(cover.select("query_id", "passage_id", F.when(F.col("total") > 0, F.col("c") / F.col("total")).otherwise(0.0).alias("coverage")), "coverage")
    seeded = written(questions.join(total.select("query_id"), "query_id", "left_semi").select("query_id", *([] if within is None else [within]), "embedding"), "seeded")
    near = dense(passages, seeded, k, within).select("query_id", "passage_id", "score")
    near = written(near, "near")
    q = seeded.select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    reached = join_checked(with_vectors(cover, passages, "passage_id", "v"), q, "query_id").select("query_id", "passage_id", dot(F.col("q"), F.col("v")).alias("score"), "coverage")
    alone = near.join(cover.select("query_id", "passage_id"), ["query_id", "passage_id"], "left_anti").withColumn("coverage", F.lit(0.0))
    both = written(reached.unionByName(alone), "fused")
    most = both.groupBy("query_id").agg(F.max("score").alias("ms"), F.greatest(F.max("coverage"), F.lit(0.0)).alias("mc"))
    scaled = lambda x, m: F.when(F.col(m) > 0, F.col(x) / F.col(m)).otherwise(F.col(x))
    out = join_checked(both, written(most, "maxima"), "query_id").select("query_id", "passage_id", (scaled("score", "ms") * lam + scaled("coverage", "mc") * (1 - lam)).alias("score"))
    return ranked(out, k, "score", "passage_id").select("query_id", "rank", "passage_id", "score")


def retrieve(questions: DataFrame, mentions: DataFrame, entities: DataFrame | Shared, inc: DataFrame, units: DataFrame | Shared, weights: DataFrame | WeightsOf, idf: DataFrame | None, passages: DataFrame | Shared, config: Config | None = None, gates: DataFrame | None = None, within: str | None = None) -> DataFrame:
    """(query_id, rank, passage_id, score) of all questions; gates as in expand, for Config(gate="subquery"). Those with seeds are expanded and fused, the others are dense (their scores are plain cosines).

    within: a column of questions, mentions, entities, units and passages, whose values are corpora of their own (with keys as in
    functions.scope, by which all other tables are apart already).
    """
    c = config or Config()
    k = c.rerank_candidates if c.rerank else c.top_k
    seeds = written(seed_entities(mentions, entities, within=within), "seeds")
    active = expand(inc, units, questions, seeds, entities, c, gates if c.gate == "subquery" else None)
    fused = fuse(active, weights, idf, passages, questions, c.scoring_lambda, k, within)
    plain = questions.join(seeds.select("query_id").distinct(), "query_id", "left_anti")
    if c.fallback == "su_preexpand":
        near = nearest(units, plain, c.top_k, "su_id", within=within)
        by_unit = near.join(inc, "su_id").groupBy("query_id", "entity_id").agg(F.max("score").alias("score")).withColumn("ord", F.lit(0))
        pre = expand(inc, units, plain, by_unit.select("query_id", "ord", "entity_id", "score"), entities, c)
        fused = fused.unionByName(fuse(pre, weights, idf, passages, plain, c.scoring_lambda, k, within))
        plain = plain.join(by_unit.select("query_id").distinct(), "query_id", "left_anti")
    return fused.unionByName(dense(passages, plain, k, within).select("query_id", "rank", "passage_id", "score"))


def rerank(candidates: DataFrame, score: Column, k: int) -> DataFrame:
    """Candidates (with query_id and passage_id) ordered by a reranker's score column and cut."""
    return ranked(candidates.drop("rank", "score").withColumn("score", score), k, "score", "passage_id")
