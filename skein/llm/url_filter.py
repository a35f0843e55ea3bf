"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the URLs that no rule judges.

The trees are fitted on a bounded table of labelled URLs (SAMPLE rows at most) by Spark's own GBTClassifier, and then compiled to
CASE expressions, so that scoring is one projection over the url column: no shuffle, no Python, and nothing but the table of
suffixes beside it, which is broadcast behind a check of its size. Features are lexical: lengths, depth, shares of digits and of
other signs, entropies, counts of parameters and labels, and what the labelled URLs say about the host's suffix.

Rules are a list of (host, path, verdict) for a policy of some hundred entries. A rule fits its host and all subdomains where the
URL's path starts with the rule's; the longest fitting one wins, of equally long ones a blocking one.

Defined cases: a null url, and one without `://`, has an empty host and path, fits no rule and is judged by its (zero) features;
an empty url as well; repeated rows are judged each; an empty table gives an empty result; further columns stay, those named like
new ones are replaced. Unknown suffixes have the share of all labelled URLs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.ordering import fresh

from ._shared import bounded_batches, join_checked, written

#: The policy of the registered query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Labelled rows that are used at most, and the score from which a URL is blocked (where generated URLs of another seed are told apart best).
SAMPLE, CUT = 20_000, 0.8
TREES, DEPTH, STEP = 20, 4, 0.2
#: Rows that a suffix needs before its own share outweighs that of all.
PRIOR = 20


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the rule that wins, or null."""
    found = None
    for name, prefix, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0], r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        said = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, said) if found is None else found.when(fits, said)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def _share(text: Column, pattern: str) -> Column:
    return F.when(F.length(text) > 0, _count(text, pattern) / F.length(text)).otherwise(0.0)


def entropy(text: Column) -> Column:
    """Bits a character of the distribution of characters; 0 for an empty text. Of a text of more than 2,000 characters each character's code modulo 128 counts, so that no text costs more than 128 passes over it."""
    n = F.length(text)
    sign = F.filter(F.split(text, ""), lambda c: c != "")
    kinds = F.array_distinct(sign)
    each = F.transform(kinds, lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    folded = F.transform(sign, lambda c: F.ascii(c) % 128)
    coarse = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.size(F.filter(folded, lambda c: c == i)))
    counts = F.when(n <= 2000, each).otherwise(F.filter(coarse, lambda k: k > 0))
    return F.when(n > 0, F.aggregate(counts, F.lit(0.0), lambda s, k: s - k / n * F.log2(k / n))).otherwise(0.0)


def features(url: Column) -> dict[str, Column]:
    """Lexical features of a url, by name; suffix statistics are joined (see `Filter`)."""
    u = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    name = F.regexp_replace(host, r"\.?[^.]*$", "")
    return {
        "url_length": F.length(u).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"), "query_length": F.length(query).cast("double"),
        "labels": _count(host, r"\."), "depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("double"), "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double"),
        "digit_share": _share(u, r"[0-9]"), "host_digits": _count(host, r"[0-9]"), "host_hyphens": _count(host, r"-"), "path_hyphens": _count(path, r"[-_]"),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), F.length)), F.lit(0)).cast("double"), "escapes": _count(u, r"%[0-9A-Fa-f]{2}") / 3, "vowel_share": _share(name, r"[aeiou]"),
        "host_entropy": entropy(name), "path_entropy": entropy(path), "secure": u.startswith("https://").cast("double"),
    }


SUFFIX_FEATURES = ("suffix_share", "suffix_count")


class Filter:
    """Fitted trees as an expression on feature columns, and the table of suffixes (suffix, suffix_share, suffix_count)."""

    def __init__(self, trees: list, weights: list[float], names: list[str], suffixes: DataFrame, share: float):
        self.trees, self.weights, self.names, self.suffixes, self.share = trees, weights, names, suffixes, share

    def score(self) -> Column:
        """The probability of label 1, from the columns that `scored` sets."""
        margin = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            margin = margin + F.lit(weight) * _case(tree, self.columns)
        return 1 / (1 + F.exp(-2 * margin))

    def scored(self, urls: DataFrame, url_col: str = "url", name: str = "score") -> DataFrame:
        """urls with the score; their own columns stay in place."""
        own = [c for c in urls.columns if c != name]
        struct, suffix, of, share, count = fresh(own, "lexical", "suffix", "of", "suffix_share", "suffix_count")
        url = F.col(f"`{url_col}`")
        rows = urls.select(*[F.col(f"`{c}`") for c in own], F.struct(*[c.alias(n) for n, c in features(url).items()]).alias(struct), suffix_of(host_of(url)).alias(suffix))
        known = self.suffixes.select(F.col("suffix").alias(of), F.col("suffix_share").alias(share), F.col("suffix_count").alias(count))
        rows = join_checked(rows, known, F.col(suffix) == F.col(of), "left")
        self.columns = [F.col(struct)[n] for n in self.names[:-2]] + [F.coalesce(F.col(share), F.lit(self.share)), F.coalesce(F.col(count), F.lit(0.0))]
        return rows.select(*[F.col(f"`{c}`") for c in own], self.score().alias(name))


def _case(node, columns: list[Column]) -> Column:
    """A tree as nested CASE: (feature, threshold, left, right) or a leaf's value."""
    if isinstance(node, float):
        return F.lit(node)
    feature, threshold, left, right = node
    return F.when(columns[feature] <= threshold, _case(left, columns)).otherwise(_case(right, columns))


def _tree(node):
    """A fitted tree's nodes as tuples."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, step: float = STEP, sample: int = SAMPLE, seed: int = 17) -> Filter:
    """Trees for labelled URLs (url, label: 1 is what a filter blocks). Of more than `sample` rows those with the smallest hash are used; rows without a url or label don't count.

    The statistics of a suffix are those of the other rows, so that a row's own label is none of its features.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = labelled.sparkSession
    rows = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label"))
    rows = written(rows.orderBy(F.xxhash64("url", F.lit(seed)), "url", "label").limit(sample), "labelled-urls", 1)
    rows = rows.withColumn("suffix", suffix_of(host_of(F.col("url"))))
    share, n = rows.agg(F.avg("label"), F.count(F.lit(1))).first()
    if not n:
        raise ValueError("no labelled URL")
    sums = rows.groupBy("suffix").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).cast("double").alias("n"))
    suffixes = written(sums.select("suffix", ((F.col("ones") + PRIOR * share) / (F.col("n") + PRIOR)).alias("suffix_share"), F.col("n").alias("suffix_count"), "ones"), "suffixes", 1)
    both = rows.join(suffixes.select(F.col("suffix").alias("of"), "ones", "suffix_count"), F.col("suffix") == F.col("of"))
    others = (F.col("ones") - F.col("label") + PRIOR * share) / (F.col("suffix_count") - 1 + PRIOR)
    names = [*features(F.col("url")), *SUFFIX_FEATURES]
    table = both.select("label", *[c.alias(k) for k, c in features(F.col("url")).items()], others.alias("suffix_share"), F.col("suffix_count"))
    table = VectorAssembler(inputCols=names, outputCol="features").transform(table).select("label", "features")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, maxBins=64, seed=seed, maxMemoryInMB=64).fit(written(table, "features", 2))
    return Filter([_tree(t.rootNode()) for t in model._java_obj.trees()], list(model.treeWeights), names, suffixes.drop("ones"), float(share))


def judged(urls: DataFrame, model: Filter, rules: Sequence[tuple[str, str, str]] = RULES, cut: float = CUT, url_col: str = "url") -> DataFrame:
    """urls with host, path, rule, score and verdict: the rule's, else `block` where the score reaches the cut."""
    new = ("host", "path", "rule", "score", "verdict")
    own = [c for c in urls.columns if c not in new]
    (score,) = fresh([*own, *new], "url_score")
    rows = model.scored(urls.select(*[F.col(f"`{c}`") for c in own]), url_col, score)
    url = F.col(f"`{url_col}`")
    rule = rule_of(host_of(url), path_of(url), rules)
    verdict = F.coalesce(rule["verdict"], F.when(F.col(score) >= cut, "block").otherwise("allow"))
    return rows.select(*[F.col(f"`{c}`") for c in own], host_of(url).alias("host"), path_of(url).alias("path"), rule["rule"].alias("rule"), F.col(score).alias("score"), verdict.alias("verdict"))


# Labelled URLs for want of a table of them: shapes of ordinary and of promotional addresses, made by Spark from hashes.

_SYLLABLES = "ba co di fe ga ho in ka le mo na or pe qui ra so ti un ve wa xi yo ze st nd er".split()
_PLACES = "about archive article blog doc en forum guide help item list news notes page people post product topic wiki year".split()
_OFFERS = "best bonus buy cash cheap club deal direct fast free gift hot lucky mega offer online price promo quick sale shop star top vip win".split()
_PARAMS = "aff adid cid click gclid offer pid ref rid sid src sub tid track utm_campaign utm_medium".split()


def labelled_urls(spark: SparkSession, rows: int = 8_000, seed: int = 5) -> DataFrame:
    """(url, label): half ordinary URLs (0), half promotional ones (1). Both kinds share suffixes, subdomains, hyphens, digits and parameters in differing measure, so that no single sign tells them apart."""

    def h(*salt) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), *[F.lit(x) for x in salt]), F.lit(1 << 30))

    def some(words: list[str], *salt) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), (h(*salt) % len(words) + 1).cast("int"))

    def often(share: float, *salt) -> Column:
        return h(*salt, "often") % 1000 < int(share * 1000)

    def word(least: int, most: int, *salt) -> Column:
        parts = [F.when(F.lit(i) < least + h(*salt, "n") % (most - least + 1), some(_SYLLABLES, *salt, i)).otherwise("") for i in range(most)]
        return F.concat(*parts)

    def either(plain: Column, promoted: Column) -> Column:
        return F.when(F.col("label") == 0, plain).otherwise(promoted)

    rows_ = spark.range(0, rows, 1, 4).withColumn("label", (F.xxhash64("id", F.lit(seed)) % 2 == 0).cast("int"))
    suffix = either(some(["com", "org", "net", "edu", "de", "fr", "es", "info"], "s"), some(["com", "net", "info", "biz", "xyz", "top", "club", "org"], "s"))
    front = F.when(often(0.35, "f"), some(["www.", "m.", "blog.", "docs.", "news."], "f")).otherwise("")
    plain = F.concat(word(2, 5, "d"), F.when(often(0.12, "dh"), F.concat(F.lit("-"), word(1, 3, "d2"))).otherwise(""), F.when(often(0.04, "dd"), (h("dn") % 100).cast("string")).otherwise(""), F.when(often(0.3, "dx"), F.concat(F.lit("."), word(2, 3, "d3"))).otherwise(""))
    pieces = F.concat(some(_OFFERS, "o1"), F.when(often(0.75, "oh"), "-").otherwise(""), F.when(often(0.6, "ow"), some(_OFFERS, "o2")).otherwise(word(1, 3, "o3")), F.when(often(0.35, "o4"), F.concat(F.lit("-"), some(_OFFERS, "o4"))).otherwise(""), F.when(often(0.3, "on"), (h("on") % 1000).cast("string")).otherwise(""), F.when(often(0.35, "ox"), F.concat(F.lit("."), word(2, 3, "o5"))).otherwise(""))
    noise = F.concat(F.substring(F.md5(h("z").cast("string")), 1, 8), F.lit("."), word(2, 3, "z2"))
    host = F.concat(front, either(plain, F.when(often(0.12, "z"), noise).otherwise(pieces)), F.lit("."), suffix)
    tail = F.concat(F.lit("/"), some(_PLACES, "p1"), F.when(often(0.6, "p2"), F.concat(F.lit("/"), (h("p2") % 10_000).cast("string"))).otherwise(""), F.when(often(0.3, "p3"), F.concat(F.lit("/"), word(2, 4, "p3"), F.lit("-"), word(2, 4, "p4"))).otherwise(""), F.when(often(0.2, "p5"), ".html").otherwise(""))
    path = F.when(often(0.08, "p"), "").otherwise(either(tail, F.when(often(0.5, "q"), F.concat(F.lit("/"), some(_OFFERS, "q1"), F.lit("-"), some(_OFFERS, "q2"), F.when(often(0.3, "q3"), F.concat(F.lit("/"), F.substring(F.md5(h("q3").cast("string")), 1, 12))).otherwise(""))).otherwise(tail)))
    pair = lambda i: F.concat(some(_PARAMS, "k", i), F.lit("="), F.substring(F.md5(h("v", i).cast("string")), 1, 6))
    many = either(F.when(often(0.25, "a"), 1 + h("an") % 2).otherwise(0), F.when(often(0.5, "a"), 1 + h("an") % 4).otherwise(0))
    query = F.concat(*[F.when(F.lit(i) < many, F.concat(F.lit("?" if i == 0 else "&"), pair(i))).otherwise("") for i in range(4)])
    end = F.when(often(0.15, "e"), "#top").otherwise("")
    return rows_.select(F.concat(F.when(often(0.7, "c"), "https://").otherwise("http://"), host, path, query, end).alias("url"), "label")


def trained(spark: SparkSession, labelled: DataFrame | None = None) -> Filter:
    """Trees for the given labelled URLs, or else for generated ones."""
    bounded_batches(spark)
    return fit(labelled_urls(spark) if labelled is None else labelled)
