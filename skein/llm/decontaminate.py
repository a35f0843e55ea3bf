"""Benchmark decontamination with DataFrame functions only.

A window is `window` consecutive words of a benchmark item, or the whole item where it has fewer. Any window of k words
that occurs in a document covers at least one whole block of (k + 1) // 2 document words that starts at a multiple of that
length. So the scan cuts each text once and looks up the hashes of just those blocks, for all lengths k that the items have, in
a broadcast hash set of the items' word n-grams. Documents with a hit are then read again: each hit takes its neighbourhood on
both sides, is compared word by word, and is grown to the longest equal run. A run of k words or more is a hit; the runs of a
document's hits hold all occurrences and nothing else. Which items hold a run is a table of its own, joined after that.

Texts are shuffled only where the places of the hits outgrow a broadcast, and then just with their own document; the filter
takes away few (id, digest) pairs and moves no text.

Defined cases: a null or wordless text has no words, no hits and no items; a null or wordless item has no windows; repeated
rows (of documents or items) count as the same row, and each document row gets its result; further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import foreign_kept, is_small, join_checked, task_count, written

#: What lies between words, and the letters that are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes of n-grams up to which their set is broadcast (eight bytes each); beyond it the lookup is a shuffle join.
BROADCAST_GRAMS = 2_000_000


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def _part(words: Column, first: Column, last: Column) -> Column:
    """Words first to last (from 0, end exclusive, within bounds)."""
    return F.slice(words, first + 1, last - first)


def _items(items: DataFrame) -> DataFrame:
    """(item_id, text_id, words): items with the same words have one text_id. A null item_id counts as no item, but its words are looked up."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where("size(words) > 0").distinct()
    return words.select("item_id", F.md5(F.array_join("words", " ")).alias("text_id"), "words")


def _grams(items: DataFrame, window: int) -> DataFrame:
    """(hash, k, gram, before, after, text_id, q): each word n-gram of the items' texts with its neighbourhood."""
    words = items.dropDuplicates(["text_id"]).select("text_id", "words", F.least(F.size("words"), F.lit(window)).alias("k"), F.size("words").alias("n"))
    words = words.withColumn("b", F.floor((F.col("k") + 1) / 2).cast("int"))
    at = words.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("b"))))
    w, q, b, side = F.col("words"), F.col("q"), F.col("b"), F.col("k") - F.col("b")
    gram = _part(w, q, q + b)
    return at.select(
        F.xxhash64("k", gram).alias("hash"), "k", gram.alias("gram"), _part(w, F.greatest(q - side, F.lit(0)), q).alias("before"), _part(w, q + b, F.least(q + b + side, F.col("n"))).alias("after"), "text_id", "q"
    )


def _equal_from_left(a: Column, b: Column) -> Column:
    """The number of leading elements that two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.get(a, i - 1) != F.get(b, i - 1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(differs, F.lit(0)) - 1, n))


def _blocks(words: Column, k: int) -> Column:
    """The whole blocks of a text for windows of k words: place, k and hash."""
    b = (k + 1) // 2
    n = F.when(F.size(words) >= k, F.floor(F.size(words) / b).cast("int")).otherwise(0)
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct((i * b).alias("p"), F.lit(k).alias("k"), F.xxhash64(F.lit(k), _part(words, i * b, i * b + b)).alias("hash")))


def _digest(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def hit_spans(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each equal run: __id, __hash (of the text), n_words, first and last (words from 0, end exclusive), v_text and v_q (a text of items that holds it, and where)."""
    return _hit_spans(docs, written(_items(items), "items", task_count(items)), window, id_col, text_col)[0]


def _hit_spans(docs: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """hit_spans, and (v_text, v_q, text_id): all texts of items that hold what v_text has at v_q."""
    few, own_few = task_count(items), task_count(docs)
    grams = written(_grams(items, window), "grams", few)
    variants = grams.groupBy("hash", "k", "gram", "before", "after").agg(F.min(F.struct("text_id", "q")).alias("v"))
    variants = written(variants.select("hash", "k", "gram", "before", "after", F.col("v.text_id").alias("v_text"), F.col("v.q").alias("v_q")), "variants", few)
    same = [F.col(f"g.{c}") == F.col(f"v.{c}") for c in ("hash", "k", "gram", "before", "after")]
    texts = grams.alias("g").join(variants.alias("v"), same).select("v.v_text", "v.v_q", "g.text_id").distinct()
    lengths = sorted(r["k"] for r in grams.select("k").distinct().collect())  # `window` rows at most
    none = F.array().cast("array<struct<p:int,k:int,hash:bigint>>")
    cut = docs.select(F.col(id_col).alias("__id"), _digest(text_col).alias("__hash"), words_of(F.col(text_col)).alias("words"))
    blocks = cut.select("__id", "__hash", F.explode(F.concat(none, *[_blocks(F.col("words"), k) for k in lengths])).alias("x")).select("__id", "__hash", "x.*")
    known = written(variants.select(F.col("hash").alias("__known")).distinct(), "hashes", few)
    hits = join_checked(blocks, known, F.col("hash") == F.col("__known"), "left_semi", BROADCAST_GRAMS)
    places = hits.groupBy(F.col("__id").alias("__i"), F.col("__hash").alias("__h")).agg(F.collect_set(F.struct("p", "k", "hash")).alias("places"))  # a document's blocks at most
    places = written(places, "places", own_few)
    whole = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), _digest(text_col).alias("__hash"))
    again = join_checked(whole, places, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")))
    again = again.select("__i", "__h", words_of(F.col("__text")).alias("words"), "places").withColumn("x", F.explode("places")).select("__i", "__h", "words", F.size("words").cast("long").alias("n_words"), "x.*")
    w, p, k, b = F.col("words"), F.col("p"), F.col("k"), F.floor((F.col("k") + 1) / 2).cast("int")
    near = again.select(
        F.col("__i").alias("__id"), F.col("__h").alias("__hash"), "n_words", "p", "k", "hash", b.alias("b"), _part(w, p, p + b).alias("own"),
        F.reverse(_part(w, F.greatest(p - (k - b), F.lit(0)), p)).alias("own_before"), _part(w, p + b, F.least(p + k, F.size(w))).alias("own_after"),
    ).distinct()
    side = variants.select(F.col("hash").alias("v_hash"), F.col("k").alias("v_k"), "gram", F.reverse("before").alias("before"), "after", "v_text", "v_q")
    found = near.join(F.broadcast(side) if is_small(variants) else side, (F.col("hash") == F.col("v_hash")) & (F.col("k") == F.col("v_k"))).where("own = gram")
    found = found.withColumn("left", _equal_from_left(F.col("own_before"), F.col("before"))).withColumn("right", _equal_from_left(F.col("own_after"), F.col("after")))
    found = found.where(F.col("left") + F.col("b") + F.col("right") >= F.col("k"))
    runs = found.select("__id", "__hash", "n_words", (F.col("p") - F.col("left")).alias("first"), (F.col("p") + F.col("b") + F.col("right")).alias("last"), "v_text", "v_q").distinct()
    return written(runs, "runs", own_few), texts


def _by_document(runs: DataFrame) -> DataFrame:
    """(__id, __hash, __spans, __hit, __bad): the runs of each document, its hit words and whether it is contaminated."""
    by_doc = runs.groupBy("__id", "__hash").agg(F.first("n_words").alias("__total"), F.array_sort(F.collect_set(F.struct("first", "last"))).alias("__spans"))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))

    def add(acc, s):
        return F.struct((acc["total"] + F.greatest(s["last"] - F.greatest(s["first"], acc["end"]), F.lit(0))).alias("total"), F.greatest(acc["end"], s["last"]).alias("end"))

    by_doc = by_doc.withColumn("__hit", F.aggregate("__spans", start, add)["total"].cast("long"))
    return by_doc.withColumn("__bad", F.col("__hit") * 20 >= F.col("__total"))


@foreign_kept
def contamination(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (word runs) appended.

    contaminated: some word is hit, and hit words are at least a twentieth of all. Existing columns of these names are replaced.
    """
    owners = written(_items(items), "items", task_count(items))
    runs, texts = _hit_spans(docs, owners, window, id_col, text_col)
    held = runs.select("__id", "__hash", "v_text", "v_q").distinct().join(texts, ["v_text", "v_q"]).select("__id", "__hash", "text_id").distinct()
    held = held.join(owners.select("text_id", "item_id"), "text_id").groupBy(F.col("__id").alias("__i"), F.col("__hash").alias("__h")).agg(F.array_sort(F.collect_set("item_id")).alias("__items"))
    by_doc = _by_document(runs).drop("__total").join(held, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h"))).drop("__i", "__h")
    by_doc = written(by_doc.withColumnRenamed("__id", "__d"), "hits", task_count(docs))
    left = docs.withColumn("__h", _digest(text_col)).withColumn("__n", F.size(words_of(F.col(text_col))).cast("long"))
    both = join_checked(left, by_doc, F.col(id_col).eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__hash")), "left")
    new = {
        "n_words": F.col("__n"),
        "n_hit": F.coalesce(F.col("__hit"), F.lit(0).cast("long")),
        "n_items": F.coalesce(F.size("__items"), F.lit(0)).cast("long"),
        "items_sha256": F.sha2(F.coalesce(F.array_join("__items", ","), F.lit("")), 256),
        "hit_spans": F.coalesce("__spans", F.array().cast("array<struct<first:int,last:int>>")),
        "contaminated": F.coalesce("__bad", F.lit(False)),
    }
    return both.select(*[c for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


@foreign_kept
def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are contaminated; the columns stay as they are, whatever their names."""
    runs, _ = _hit_spans(docs, written(_items(items), "items", task_count(items)), window, id_col, text_col)
    bad = written(_by_document(runs).where("__bad").select(F.col("__id").alias("__bad_id"), F.col("__hash").alias("__bad_hash")), "contaminated", task_count(docs))
    own = docs.select(*docs.columns, _digest(text_col).alias("__own_hash"))
    return join_checked(own, bad, F.col(id_col).eqNullSafe(F.col("__bad_id")) & (F.col("__own_hash") == F.col("__bad_hash")), "left_anti").drop("__own_hash")
