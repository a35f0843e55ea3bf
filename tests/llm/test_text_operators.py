"""Quality rules, decontamination, shingle join, neighbour voting, licences and personal data against brute force."""

import hashlib
import json
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import decontaminate, licenses, neighbour_vote, ngram_join, pii, pii_model, quality_rules
from skein.llm.components import components
from skein.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word and other words " * 40_000


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", "s", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# quality rules


def base_of(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_statistics(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in quality_rules.judged(docs, keep=["doc_id"]).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == base_of(r.text)
        assert not (g.base_failed and g.kept)


def brute_pools(keys, least):
    """The pool of each (lang, source) by the counts of rows."""
    n = Counter(keys)
    large = {k: c for k, c in n.items() if c >= least}
    name = lambda k: str(("s", k))
    biggest = lambda ks: max(ks, key=lambda k: (n[k], pool_key(k))) if ks else None
    in_lang = {lang: sum(c for (x, _), c in n.items() if x == lang and c < least) for lang, _ in n}
    of_lang = {lang: biggest([k for k in large if k[0] == lang]) for lang, _ in n}
    alone = [k for k in n if k not in large and in_lang[k[0]] < least and of_lang[k[0]] is None]
    rest, out = sum(n[k] for k in alone), {}
    for k in n:
        if k in large:
            out[k] = name(k)
        elif in_lang[k[0]] >= least:
            out[k] = str(("l", k[0]))
        elif of_lang[k[0]]:
            out[k] = name(of_lang[k[0]])
        elif rest >= least:
            out[k] = "*"
        else:
            out[k] = name(biggest(list(large))) if large else None
    return out


def pool_key(k):
    return json.dumps({c: v for c, v in zip(("lang", "source"), k, strict=True) if v is not None}, separators=(",", ":"))


def brute_distances(x, odd, floors):
    """The estimate of one pool, with all rows at hand: four starts, each to its end, and the least determinant."""
    floors, q = np.diag(np.array(floors) ** 2), quality_rules
    dist = lambda mean, inverse: np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)

    def estimate(near, share):
        cov = q.consistency(share) * np.cov(x[near].T, bias=True) + floors
        return x[near].mean(0), np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])

    med = np.median(x, 0)
    starts = [(med, np.linalg.inv(np.diag((1.4826 * np.median(np.abs(x - med), 0)) ** 2) + floors)), estimate(x[:, 0] > -1, 1.0)[:2], *[estimate(odd == h, 1.0)[:2] for h in (0, 1) if (odd == h).any()]]
    ends = []
    for mean, inverse in starts:
        best = (mean, inverse, np.inf)
        while True:
            bins = np.floor(np.log2(dist(*best[:2]) + 2.0**-20) * 16)
            new = estimate(bins <= np.sort(bins)[(len(x) + q.D + 1) // 2 - 1], 0.5)
            if new[2] >= best[2] - 1e-9:
                break
            best = new
        ends.append(best)
    mean, inverse, _ = min(ends, key=lambda e: e[2])
    return dist(*estimate(dist(mean, inverse) <= q.chi2_quantile(q.REWEIGHT, q.D), q.REWEIGHT)[:2])


@pytest.mark.parametrize("least", [20, 60])
def test_outliers_are_those_of_pools_in_memory(spark, least):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 7 > 0, F.col("lang")).alias("lang"), "source")
    got = {r.doc_id: r for r in quality_rules.judged(docs, keep=["doc_id"], least=least).collect()}
    rows = [(r.doc_id, (r.lang, r.source), quality_rules.statistics(r.text)) for r in docs.collect() if not got[r.doc_id].base_failed]
    floors = quality_rules.floors_of(float(np.median([s[5] for *_, s in rows])), float(np.median([s[0] for *_, s in rows])))
    vectors = spark.createDataFrame([(i, *quality_rules.vector(s)) for i, _, s in rows], "id long, " + ", ".join(f"x{i} long" for i in range(quality_rules.D)))
    odd = {r.id: r.h for r in vectors.select("id", F.pmod(F.xxhash64(*[f"x{i}" for i in range(quality_rules.D)]), F.lit(2)).alias("h")).collect()}
    pools = brute_pools([k for _, k, _ in rows], least)
    for pool in set(pools.values()):
        own = [(i, s) for i, k, s in rows if pools[k] == pool]
        want = brute_distances(np.array([quality_rules.vector(s) for _, s in own], float) / quality_rules.SCALE, np.array([odd[i] for i, _ in own]), floors)
        for (i, _), d in zip(own, want, strict=True):
            assert got[i].distance == pytest.approx(d, rel=1e-5)
            assert got[i].kept == (d <= quality_rules.chi2_quantile(1 - quality_rules.CUT_PROBABILITY, quality_rules.D))
    assert len(set(pools.values())) > 3


def test_junk_goes_and_clean_text_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality_rules.judged(docs, keep=["doc_id"]).where("not base_failed").join(labels, "doc_id").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.99
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.1


def test_quality_odd_rows(spark):
    rows = [(1, None, None, None, "a"), (1, None, None, None, "a"), (2, "", "en", None, "b"), (3, LONG, None, "s", "c"), (None, "x " * 99, "en", "s", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    got = quality_rules.judged(docs, keep=["doc_id"]).collect()
    assert len(got) == 5 and not any(r.kept for r in got)
    out = quality_rules.reject_outliers(docs)
    assert out.columns == docs.columns and out.count() == 0
    assert quality_rules.judged(docs.limit(0)).count() == 0


def test_the_covariance_of_a_pool_decides(spark):
    rng, letters = np.random.default_rng(4), "abcdefghijklmnop"

    def text(words, length, capitals):
        made = ["".join(rng.choice(list(letters), length + int(rng.integers(-1, 2)))) for _ in range(words)]
        return " ".join(w.upper() if i < capitals else w for i, w in enumerate(made))

    rows = [(i, text(int(rng.integers(90, 111)), 6, 2), "en", "s") for i in range(200)]
    rows += [(i, text(int(rng.integers(290, 331)), 8, 2), "en", "t") for i in range(200, 400)]
    odd = [(1000, text(300, 6, 2), "en", "s"), (1001, text(100, 8, 2), "en", "s"), (1002, text(100, 6, 10), "en", "s"), (1003, text(310, 8, 2), "en", "t")]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string"), keep=["doc_id"]).collect()}
    # usual elsewhere, and far from their own pool in words, word length or capitals
    assert [got[i].kept for i in (1000, 1001, 1002, 1003)] == [False, False, False, True]
    assert not any(r.base_failed for r in got.values()) and np.mean([got[i].kept for i in range(400)]) > 0.98


# decontamination

DOC = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_contamination(text, items):
    w, hit, ids = DOC.findall(ascii_lower(text)), set(), set()
    for i, t in items:
        b = DOC.findall(ascii_lower(t))
        k = min(13, len(b))
        windows = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if k else set()
        for j in range(len(w) - k + 1):
            if k and tuple(w[j : j + k]) in windows:
                hit |= set(range(j, j + k))
                ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(6)] + ["Ünder", "b2"]
    long = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    items = [(i, t) for i, t in enumerate([*long, long[0], "only three words", "one", "w1 w2 w3 w4 w5 w0 w1", None, "...", "x" * 5000])]
    texts = [None, "", "--", "Only THREE, words!", "w1 " * 30, "one", *[" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60)]]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(400))) + ". " + rng.choice(long)[rng.randrange(60) :] + " tail" for _ in range(60)] + [LONG + long[2]]
    docs = docs_of(spark, [*texts, texts[3]])
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, words string")
    got = decontaminate.contamination(docs, bench)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()} == {i: brute_contamination(t, items) for i, t in enumerate([*texts, texts[3]])}
    more = docs.withColumn("n_words", F.lit(777)).withColumn("contaminated", F.lit("mine")).withColumn("hash", F.lit(1)).withColumn("places", F.lit(2))
    kept = decontaminate.decontaminate(more, bench)
    assert kept.schema == more.schema  # the columns are those of docs, and so are their values
    clean = [i for i, t in enumerate([*texts, texts[3]]) if not brute_contamination(t, items)[4]]
    assert sorted((r.doc_id, r.n_words, r.contaminated, r.hash, r.places) for r in kept.collect()) == [(i, 777, "mine", 1, 2) for i in clean]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated or n_hit > 0 or n_words is null").count() == 0


def test_decontamination_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "other"), (None, "one two")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, "ONE  two")], "item_id long, text string")
    assert sorted((r.n_hit, r.n_items) for r in decontaminate.contamination(docs, bench).collect()) == [(0, 0), (2, 2), (2, 2), (2, 2)]
    assert [tuple(r) for r in decontaminate.decontaminate(docs, bench).collect()] == [(1, "other")]


# shingle join


def brute_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall(ascii_lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                if a != b:
                    comp = [min(a, b) if c in (a, b) else c for c in comp]
    return [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, comp, strict=True))]


def near_copies(seed, groups, size, length, edits):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w[: len(w) - rng.randrange(12)]))
    return texts


@pytest.mark.parametrize("heavy", [4, 32])
def test_join(spark, heavy):
    shared = [f"s{i}" for i in range(80)]
    rng = random.Random(1)
    texts = near_copies(2, 12, 9, 120, 5) + near_copies(3, 2, 60, 150, 6)
    texts += [" ".join(shared + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice((15, 30, 60)))]) for _ in range(60)]
    texts += [None, "", "a b", "A  B", "a b c", texts[0].upper(), texts[0], "x " * 50, LONG]
    got = ngram_join.join_components(docs_of(spark, texts), heavy=heavy)
    assert sorted(map(tuple, got.collect())) == brute_components(texts)


def test_join_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, None), (9, None)], "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.join_components(docs).collect()]
    assert Counter(got) == Counter({(None, 2, 4): 1, (4, 2, 4): 2, (9, 0, 9): 2})
    assert ngram_join.join_components(docs.limit(0)).count() == 0
    kept = ngram_join.keep_one(docs)
    assert sorted((r.doc_id, r.text is None) for r in kept.collect()) == [(4, False), (9, True)]


def test_rows_without_an_id_of_their_own_stay(spark):
    one, two, near = "a b c d e f", "g h i j k l m", " ".join(f"w{i}" for i in range(40))
    rows = [(1, one), (None, one), (None, two), (None, "other words than all the rest"), (5, "n o p q r s"), (5, near), (3, near + " more"), (7, "t u v w x"), (7, "y z aa bb cc dd"), (7, "t u v w x"), (None, None), (None, ""), (8, "T U V  w x")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["doc_id", "text"]
    want = [(1, one), (None, two), (None, rows[3][1]), (5, rows[4][1]), (3, near + " more"), (7, "t u v w x"), (7, "y z aa bb cc dd"), (None, None), (None, "")]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=12, unique=True), min_size=1, max_size=14))
def test_tree_links_join_all_linked(sets):
    arrays = [np.array(sorted(s), np.int64) for s in sets]
    tokens = np.unique(np.concatenate(arrays))
    order = ngram_join.Order(tokens[::3], np.arange(len(tokens[::3])) % 5 + 2)  # some frequent ones: any global order gives the same components
    links = ngram_join.tree_links(arrays, order)

    def comps(pairs):
        c = list(range(len(sets)))
        for i, j in pairs:
            a, b = c[i], c[j]
            c = [min(a, b) if x in (a, b) else x for x in c]
        return c

    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 4 * len(set(sets[i]) & set(sets[j])) >= 3 * len(set(sets[i]) | set(sets[j]))]
    assert comps(links) == comps(linked) and all((max(p), min(p)) in linked for p in links)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbß \n\t", max_size=30), max_size=6))
def test_shingle_sets_are_those_of_words(texts):
    names: dict = {}
    for t, s in zip(texts, shingle_sets(texts), strict=True):
        w = WORD.findall(ascii_lower(t))
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(s) == len(want)
        names.setdefault(frozenset(want), s.tobytes())
        assert names[frozenset(want)] == s.tobytes()


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    for n, m in ((30, 20), (60, 45), (40, 300)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        comp = list(range(n))
        for _ in range(n):
            for a, b in edges:
                comp[a] = comp[b] = min(comp[a], comp[b])
        got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
        assert got == {v: comp[v] for e in edges if e[0] != e[1] for v in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (100, 102)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 102: 100}


# neighbour voting


def test_vote_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = neighbour_vote.classify(docs, labels, keep=["doc_id"]).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_vote_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here"), (1, "good text here"), (2, None), (3, ""), (None, "ab"), (7, LONG)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = neighbour_vote.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.score for r in neighbour_vote.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert neighbour_vote.classify(docs.limit(0), labels).count() == 0


def test_scores_are_exact_votes():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc d"), 60)) for _ in range(40)]
    x, y = neighbour_vote.features(texts), np.array([i % 2 for i in range(40)])
    m = neighbour_vote.fit(x, y)
    z = m.latent(x)
    for i, s in enumerate(m.score(x)):
        cos = m.vectors @ z[i]
        near = np.argsort(-cos, kind="stable")[: neighbour_vote.NEIGHBOURS]
        w = np.exp(neighbour_vote.SHARPNESS * (cos[near] - cos.max()))
        assert s == pytest.approx((w * y[near]).sum() / w.sum(), abs=1e-3)


# licences


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"]
    texts = [mit, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(" ", "\n  "), mit.replace("sublicense", "sub-license").replace(",", ""), mit + " And more.", "Released under the MIT Licence", None, "", "!!", "© 2021 X", LONG]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, mit])], "doc_id long, text string, license_id string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[i].license_id for i in range(11)] == ["MIT", "MIT", "MIT", None, None, None, None, None, None, None, "MIT"]
    assert [got[i].canonical_sha256 is None for i in range(5, 9)] == [True] * 4
    assert licenses.scan(docs.limit(0)).count() == 0


def test_usual_license_files(spark):
    texts = {n: t for n, t in reversed(licenses.variants())}  # the first of each: as it is kept
    apache, gpl = texts["Apache-2.0"], texts["GPL-3.0"]
    cases = [("MIT", f"{t}\n\nCopyright (c) 2021 A. Person\n\n{texts['MIT']}") for t in ("MIT License", "The MIT License (MIT)")]
    cases += [("ISC", "ISC License\n\nCopyright (c) 2004-2010 by X\n\n" + texts["ISC"]), ("0BSD", "Zero-Clause BSD\n=============\n\n" + texts["0BSD"]), ("Zlib", "zlib License\n\n(C) 2020 Y\n\n" + texts["Zlib"])]
    cases += [("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, Z\nAll rights reserved.\n\n" + texts["BSD-3-Clause"]), ("BSD-2-Clause", "Copyright 2020 Z\n\n" + texts["BSD-2-Clause"])]
    cases += [("Apache-2.0", apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Some Body")), ("Apache-2.0", apache[: apache.index("APPENDIX")]), ("Apache-2.0", apache)]
    cases += [("GPL-3.0", gpl), ("GPL-3.0", gpl[: gpl.index("How to Apply These Terms to Your New")]), ("MPL-2.0", texts["MPL-2.0"]), ("LGPL-2.1", texts["LGPL-2.1"]), ("CC0-1.0", texts["CC0-1.0"])]
    cases += [(None, "Our project\n\n" + texts["MIT"]), (None, apache + "\nAnd more.")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    assert [r.license_id for r in licenses.scan(docs).orderBy("doc_id").collect()] == [n for n, _ in cases]


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {"email": (EMAIL, lambda s: True), "ip": (IP, lambda s: all(int(x) <= 255 for x in s.split("."))), "card": (CARD, lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s))), "phone": (PHONE, lambda s: 9 <= len(digits(s)) <= 15)}
    return [(k, m.start(), m.end()) for k, (p, good) in ok.items() for m in p.finditer(t) if good(m.group())]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["1", "25", "4111111111111111", ".", "@", "a", "b-c", " ", "-", "+", "(", ")", "é", "_", "\n", "300", "com", "4111 1111-1111 1111", "+1 (017) 555-7713"]), max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_long_runs_take_linear_time():
    for run in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + " " * 400_000, "a.b-" * 100_000 + "@"):
        pii.base_spans(run)


def right_of(found, gold):
    """Precision and recall of spans (kind, start, end), text by text."""
    right = sum(len(set(a) & set(b)) for a, b in zip(found, gold, strict=True))
    return right / max(1, sum(map(len, found))), right / max(1, sum(map(len, gold)))


def test_spans_of_generated_texts():
    """Base patterns run neighbouring numbers together and have no retries, whatever the model says; texts in which that happens tell nothing about it."""
    examples = pii_model.labelled_examples(1000, 99)
    spans = [[x[:3] for x in s] for s in pii.all_spans(pii_model.default_model(), [t for t, _ in examples])]
    told = [(s, b) for s, (t, b) in zip(spans, examples, strict=True) if set(pii.base_spans(t)) <= set(b)]
    assert len(told) > 800
    precision, recall = right_of(*zip(*told, strict=True))
    assert precision > 0.95 and recall > 0.95


def gold_texts(table, n, seed):
    """Texts with spans of spellings that no base pattern matches, set between words of real documents that hold no personal data; half have none, but numbers that fail the card check."""
    rng = random.Random(seed)
    texts = [t for (t,) in table if t and not pii.doubtful(t) and len(t.split()) > 20]
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9)))
    digits = lambda k: "".join(rng.choices("0123456789", k=k))

    def card(passes):
        while pii.luhn(d := digits(16)) != passes:
            pass
        return d

    make = {
        "email": lambda: ("", rng.choice(["{}.{} at {} dot {}", "{}_{} [at] {} [dot] {}", "{}.{} (at) {}.{}"]).format(word(), word(), word(), rng.choice(["com", "org", "net"]))),
        "ip": lambda: ("", rng.choice(["[.]", " . "]).join(str(rng.randint(1, 255)) for _ in range(4))),
        "card": lambda: ("", rng.choice("./_").join(re.findall("....", card(True)))),
        "phone": lambda: ("", rng.choice(["({}) {}-{}", "{}.{}.{}", "{}-{}-{}"]).format(digits(3), digits(3), digits(4))),
        "secret": lambda: (rng.choice(["client_secret = ", "private_token: ", "access_key=", "passcode: "]), "".join(rng.choices("0123456789abcdef", k=rng.choice([20, 32, 40])))),
    }
    out = []
    for _ in range(n):
        text, spans = " ".join(rng.choice(texts).split()[:60]) + " ", []
        if rng.random() < 0.5:
            kind = rng.choice(list(make))
            before, item = make[kind]()
            text += before
            spans.append((kind, len(text), len(text) + len(item)))
        else:
            item = card(False)
        out.append((text + item + " " + " ".join(rng.choice(texts).split()[:30]), spans))
    return out


def test_model_on_gold_spans():
    """What no pattern of the module makes, and runs of digits that fail the check left alone."""
    table = duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    texts = gold_texts(table, 600, 4)
    assert not any(set(spans) & set(pii.base_spans(t)) for t, spans in texts)
    found = [[x[:3] for x in s] for s in pii.all_spans(pii_model.default_model(), [t for t, _ in texts])]
    precision, recall = right_of(found, [s for _, s in texts])
    assert precision > 0.9 and recall > 0.8
    assert sum(len(f) for f, (_, s) in zip(found, texts, strict=True) if not s) <= 0.02 * len(texts)


def test_training_learns():
    examples = pii_model.labelled_examples(400, 5)
    losses = []
    m = pii_model.reading(pii_model.train(examples, steps=300, say=lambda step, loss: losses.append(loss)))
    assert losses[-1] < losses[0] / 2
    found = pii_model.find(m, [t for t, _ in examples[:100]])
    assert sum(len(set(a) & set(b)) for a, (_, b) in zip(found, examples, strict=False)) > 0.5 * sum(len(b) for _, b in examples[:100])


def raw_weights():
    with np.load(pii_model.WEIGHTS) as f:
        return {k: v.astype(np.float64) for k, v in f.items()}


def window_scores(w, text):
    """Scores of one window, one character and gate at a time."""
    codes, h = pii_model.encode(text).tolist(), pii_model.HIDDEN

    def states(order, d):
        s, c, out = np.zeros(h), np.zeros(h), []
        for code in order:
            z = np.concatenate([w["embed"][code], s]) @ w[f"{d}_w"] + w[f"{d}_b"]
            i, f, o = (1 / (1 + np.exp(-z[k * h : k * h + h])) for k in range(3))
            c = f * c + i * np.tanh(z[3 * h :])
            s = o * np.tanh(c)
            out.append(s)
        return out

    both = np.concatenate([states(codes, "f"), states(codes[::-1], "b")[::-1]], 1)
    return both @ w["out"] + w["bias"] - pii_model.CAUTION * (np.arange(pii_model.TAGS) % 2)


def brute_scores(w, text):
    """The weighted mean of all windows that hold a character."""
    total, n, overlap = np.zeros((len(text), pii_model.TAGS)), len(text), pii_model.OVERLAP
    for a, b in pii_model.windows(n):
        for t, row in enumerate(window_scores(w, text[a:b])):
            weight = 1.0
            if a and t < overlap:
                weight = (t + 1) / (overlap + 1)
            if b < n and b - a - t <= overlap:
                weight = (b - a - t) / (overlap + 1)
            total[a + t] += weight * row
    return total


def brute_tags(trans, scores):
    """The best path over the whole text, all tags at each character."""
    best, back = scores[0] + pii_model.START, []
    for row in scores[1:]:
        steps = best[:, None] + trans
        back.append(steps.argmax(0))
        best = steps.max(0) + row
    tags = [int((best + trans[:, 0]).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


PERSONAL = "Write to jane.doe@mail7.example.com or call +1 (017) 555-7713; token = \"9c8b45435718dcc700c184a7e303cdc64c6a8f7f\". Card 5927 2430 7427 3351, host 10.0.0.1. "


def test_every_character_is_read_in_overlapping_windows():
    w, m = raw_weights(), pii_model.default_model()
    texts = ["", "a", "one 5927243074273351 two", ("plain words without anything, " * 9 + PERSONAL) * 2, "x" * 230 + PERSONAL + "y" * 300]
    for text, got in zip(texts, pii_model.text_scores(m, texts), strict=True):
        assert got.shape == (len(text), pii_model.TAGS)
        if text:
            assert np.abs(got - brute_scores(w, text)).max() < 1e-2
    spans = [text[a:b] for text, found in zip(texts, pii_model.find(m, texts), strict=True) for _, a, b in found]
    assert sum("555-7713" in s for s in spans) == 3 and sum("9c8b" in s for s in spans) == 3  # those at window edges too


def test_decoding_is_that_of_the_whole_text():
    rng, m = np.random.default_rng(2), pii_model.default_model()
    docs = [PERSONAL * 30, "plain words " * 400 + PERSONAL, "7" * 900, ". ".join("@" * k for k in range(60)), "é" * 50]
    for scores in [*pii_model.text_scores(m, docs), *[rng.normal(0, 3, (n, pii_model.TAGS)).astype(np.float32) + np.eye(1, pii_model.TAGS, dtype=np.float32) * lead for n in (1, 2, 40, 400) for lead in (0, 4, 9, 14)]]:
        got = pii_model.decode(m, [scores])[0]
        assert got.tolist() == brute_tags(m["trans"].astype(float), scores.astype(float))
    text = "".join(docs) * 3
    whole = pii_model.decode(m, pii_model.text_scores(m, [text]))[0]
    for held in (256, 1000, 5000):
        assert (pii_model.long_tags(m, text, held) == whole).all()


def test_gradients():
    m = pii_model.new_model(1)
    x, y = pii_model._targets(pii_model.labelled_examples(3, 5))
    _, g = pii_model._gradients(m, x, y)
    rng = np.random.default_rng(0)
    for k in ("trans", "out", "f_w", "b_w", "f_b", "embed"):
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in m[k].shape)
            if abs(g[k][at]) < 1e-5:
                continue
            up, down = ({**m, k: m[k].copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            slope = (pii_model._gradients(up, x, y)[0] - pii_model._gradients(down, x, y)[0]) / 2e-5
            assert slope == pytest.approx(g[k][at], rel=1e-3, abs=1e-6)


def test_spelt_out_addresses():
    text = ("filler words go here " * 12 + "write to jane [at] host [dot] org now. ") * 6
    spans = pii.all_spans(pii_model.default_model(), [text])[0]
    assert [text[a:b] for k, a, b, _ in spans if k == "email"] == ["jane [at] host [dot] org"] * 6


def test_detect_and_redact(spark):
    texts = [None, "", "no data", "mail a.b@c.org, ip 10.0.0.1 card 4111 1111 1111 1111 tel +1 (017) 555-7713.", "x" * 200_000 + " a@b.de"]
    docs = spark.createDataFrame([(i, t, len(t or ""), "s") for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in pii.span_digests(pii.detect(docs, keep=["doc_id"])).collect()}
    for i, t in enumerate([*texts, texts[3]]):
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) - {""} <= set(got[i].spans.split(","))
    out = pii.redact(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[3].text == "mail <EMAIL>, ip <IP> card <CARD> tel <PHONE>." and rows[3].n_chars == len(rows[3].text) and rows[3].spans == "s"
    assert rows[0].text is None and pii.detect(docs.limit(0)).count() == 0


def test_the_filter_keeps_what_is_judged_so(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("kept", F.lit("mine"))
    want = {r.doc_id for r in quality_rules.judged(docs, keep=["doc_id"]).where("kept").collect()}
    out = quality_rules.reject_outliers(docs)
    assert out.schema == docs.schema and {r.doc_id for r in out.collect()} == want and {r.kept for r in out.collect()} == {"mine"}


def test_reading_uses_no_slow_functions(monkeypatch):
    """All gates are 1 / (1 + exp), full windows are turned at once, and no batch has rows of a power of two (cache sets)."""
    texts = ["Write to ann.lee@example.com or 10.0.0.1. " * 40, "x", "", "plain words " * 30]
    monkeypatch.setattr(pii_model.np, "tanh", None)
    assert pii_model.BATCH & (pii_model.BATCH - 1)
    scores = pii_model.text_scores(pii_model.default_model(), texts)
    assert [len(s) for s in scores] == [len(t) for t in texts] and all(np.isfinite(s).all() for s in scores)
    for t, s in zip(texts, scores, strict=True):
        assert np.abs(pii_model.text_scores(pii_model.default_model(), [t])[0] - s).max(initial=0) < 1e-4
    huge = {k: v * 1000 if k in ("f", "b") else v for k, v in pii_model.default_model().items()}
    assert all(np.isfinite(s).all() for s in pii_model.text_scores(huge, texts))


def test_only_characters_are_read(monkeypatch):
    """Windows that have ended are left out of a batch, rather than read as padding."""
    read, states = [], pii_model._states
    monkeypatch.setattr(pii_model, "_states", lambda joint, embed, codes, live, *more: (read.append(sum(live)), states(joint, embed, codes, live, *more)))
    sizes = [250, 100, 3, 1]
    alone = [pii_model.emissions(pii_model.default_model(), [np.full(n, 5, np.uint8)])[0] for n in sizes]
    together = pii_model.emissions(pii_model.default_model(), [np.full(n, 5, np.uint8) for n in sizes])
    assert read[-2:] == [sum(sizes)] * 2
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(alone, together, strict=True))


def test_scores_stay_as_made(monkeypatch):
    """Only the lead of O is gathered for whole texts; scores only for the stretches that are decoded, and both are those of all overlapping windows."""
    m, rng, word = pii_model.default_model(), np.random.default_rng(6), "plain words and a.b@c.org or 5927243074273351 "
    texts = [(word * 20)[i : i + n] for i, n in enumerate((0, 1, 31, 32, 33, 223, 224, 225, 256, 257, 288, 448, 480, 481, 704, 705))] + ["é" * 300]
    scores = []
    for t in texts:
        total = np.zeros((len(t), pii_model.TAGS))
        for a, b in pii_model.windows(len(t)):
            own = pii_model.emissions(m, [pii_model.encode(t[a:b])])[0].astype(float)
            ramp = np.arange(1, pii_model.OVERLAP + 1)[:, None] / (pii_model.OVERLAP + 1)
            own[: pii_model.OVERLAP] *= ramp if a else 1
            own[-pii_model.OVERLAP :] *= ramp[::-1] if b < len(t) else 1
            total[a:b] += own
        scores.append(total)
    monkeypatch.setattr(pii_model, "BATCH", 7)
    leads, take = pii_model._read(m, [pii_model.encode(t) for t in texts])
    for k, s in enumerate(scores):
        assert leads[k].shape == (len(s),) and np.abs(leads[k] - (s[:, 0] - s[:, 1:].max(1))).max(initial=0) < 1e-4
        for a, b in [(0, len(s)), *np.sort(rng.integers(0, len(s) + 1, (20, 2))).tolist()]:
            assert np.abs(take(k, a, b) - s[a:b]).max(initial=0) < 1e-4
    decoded, viterbi, long = [], pii_model.viterbi, [("plain words without anything, " * 40 + PERSONAL) * 2]
    want = [pii_model.spans_of(tags) for tags in pii_model.decode(m, pii_model.text_scores(m, [*texts, *long]))]
    monkeypatch.setattr(pii_model, "text_scores", None)
    assert pii_model.find(m, [*texts, *long]) == want and all(want[-1:])
    monkeypatch.setattr(pii_model, "viterbi", lambda trans, s, start: (decoded.append(sum(map(len, s))), viterbi(trans, s, start))[1])
    pii_model.find(m, long)
    assert 0 < decoded[0] < len(long[0]) / 2
