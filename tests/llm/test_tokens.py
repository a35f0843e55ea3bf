"""Token operators against the library itself, one text at a time."""

import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm import packing, token_counts, token_files
from skein.llm._shared import tokenizer_path, work_path
from skein.llm.tokenize import PieceEncoder

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a  b\n\nc\td", "x<|endoftext|> y <|endoftext|>", "it's I'LL 'S we'd", "é é ñ z", "word " * 3000, "١٢٣ 𝒳 ß", "a\x1cb　c"]


@functools.cache
def library(name):
    return Tokenizer.from_file(tokenizer_path(name))


def one_by_one(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sS dD.,\n\t 1é́ <|>ſŞ")), max_size=60))
def test_pieces_encode_as_whole_texts(name, text):
    enc = ENCODERS.setdefault(name, PieceEncoder(tokenizer_path(name)))
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


ENCODERS: dict = {}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_token_files_round_trip(spark):
    for docs in (frame(spark, ODD), documents(spark), frame(spark, [])):
        folder = work_path(spark, "t")
        token_files.write_token_files(docs, folder)
        got = sorted(map(tuple, token_files.read_index(spark, folder).collect()))
        want, at = [], 0
        for r in sorted(docs.collect(), key=lambda r: r.doc_id):
            ids = [*one_by_one("word_bpe_49k.json", r.text), 1]
            want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert got == want


def test_token_files_null_and_repeated_ids(spark):
    folder = work_path(spark, "t")
    token_files.write_token_files(spark.createDataFrame([(None, "b"), (3, "a b"), (3, "a b")], "doc_id long, text string"), folder)
    assert sorted((r.doc_id is not None, r.start, r.n_tokens) for r in token_files.read_index(spark, folder).collect()) == [(False, 0, 2), (True, 2, 3), (True, 5, 3)]


def test_counts_and_cache(spark):
    cache = work_path(spark, "cache")
    for docs in (frame(spark, [*ODD, ODD[3]]), documents(spark), frame(spark, [])):
        got = token_counts.count_tokens(docs, cache=cache).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
        assert sorted(map(tuple, got)) == sorted((r.doc_id, len((r.text or "").encode()), n := len(one_by_one("byte_bpe_50k.json", r.text)), n > 512) for r in docs.collect())
    before = spark.read.parquet(cache).count()
    token_counts.count_tokens(documents(spark), cache=cache).count()
    stored = spark.read.parquet(cache)
    assert stored.count() == before == stored.distinct().count()  # nothing was encoded anew


def check_packing(docs, capacity, rows):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    assert {r.doc_id for r in docs} == set(by_doc)
    total = 0
    for r in docs:
        ids = [*one_by_one("word_bpe_49k.json", r.text), 1]
        total += len(ids)
        own = sorted(by_doc[r.doc_id], key=lambda x: x.piece)
        assert [(x.piece, x.start, x.length, x.ids_crc32) for x in own] == [(k, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    for own in by_bin.values():
        at = 0
        for x in sorted(own, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= capacity
    return len(by_bin), -(-total // capacity)


def test_packing(spark):
    for docs in (frame(spark, ODD), documents(spark)):
        for capacity in (64, 4096):
            bins, least = check_packing(docs.collect(), capacity, packing.pack(docs, capacity=capacity).collect())
            assert least <= bins <= least + 1
    assert packing.pack(frame(spark, [])).count() == 0


def test_local_search_empties_bins():
    # best fit makes 6 + 4, 5 + 4, 4 + 3 + 2 and 2 of these; 6 + 4, 5 + 3 + 2 and 4 + 4 + 2 are enough
    start = packing.best_fit({6: 1, 5: 1, 4: 3, 3: 1, 2: 2}, 10)
    done = packing.local_search(start, 10)
    assert (sum(n for _, n in start), sum(n for _, n in done)) == (4, 3)
    items = lambda bins: sorted(x for p, n in bins for x, k in p.items() for _ in range(n * k))
    assert items(done) == items(start) and all(packing._fill(p) <= 10 for p, _ in done)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=120))
def test_packing_of_any_lengths(lengths):
    from collections import Counter

    bins = packing.local_search(packing.best_fit(dict(Counter(lengths)), 40), 40)
    items = sorted(x for p, n in bins for x, k in p.items() for _ in range(n * k))
    assert items == sorted(lengths) and all(packing._fill(p) <= 40 for p, _ in bins)
    assert sum(n for _, n in bins) <= 1.25 * -(-sum(lengths) // 40) + 1 or max(lengths) > 13


def thirds(n):
    """Lengths that fill n bins by threes."""
    from collections import Counter

    rng, out = np.random.default_rng(0), Counter()
    for a, b in rng.integers(1265, 1465, (n, 2)).tolist():
        out.update([a, b, 4096 - a - b])
    return dict(out)


def test_search_has_no_end_but_its_own():
    for n in (1000, 8000):  # more surplus bins do not leave more of them behind
        start = packing.best_fit(thirds(n), 4096)
        done = packing.local_search(start, 4096)
        assert sum(k for _, k in start) > 1.08 * n and sum(k for _, k in done) < 1.015 * n
    many = [(p, 50_000 * k) for p, k in packing.best_fit(thirds(50), 4096)]  # equal bins change together
    assert sum(k for _, k in packing.local_search(many, 4096)) < 1.05 * 50 * 50_000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(5, 40), min_size=1, max_size=40))
def test_search_leaves_no_exchange(lengths):
    from collections import Counter
    from itertools import combinations

    bins = packing.local_search(packing.best_fit(dict(Counter(lengths)), 41), 41)
    flat = [[x for x, k in p.items() for _ in range(k)] for p, n in bins for _ in range(n)]
    if len(flat) == packing._least_bins(bins, 41):
        return
    some = lambda items, k: {sum(c) for c in combinations(items, k)}
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            gains = {x - y for m, n in ((1, 0), (1, 1), (1, 2), (2, 1)) for x in some(a, m) for y in some(b, n)} if i != j else ()
            assert not [g for g in gains if g > 0 and sum(a) < sum(b) + g <= 41]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
def test_lower_bound_of_bins(lengths):
    def fewest(items, rooms):
        if not items:
            return len(rooms)
        x, rest = items[0], items[1:]
        tries = [fewest(rest, [*rooms[:i], r - x, *rooms[i + 1 :]]) for i, r in enumerate(rooms) if r >= x]
        return min([*tries, fewest(rest, [*rooms, 12 - x])])

    assert packing._least_bins([({x: 1}, 1) for x in lengths], 12) <= fewest(sorted(lengths, reverse=True), [])


def test_counts_of_hot_and_shared_texts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "HOT_ROWS", 5)
    rows = [(i, "one text of many") for i in range(40)] + [(None, "no id")] * 3 + [(7, "another id 7"), (7, "a third id 7"), (7, "a third id 7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cache = work_path(spark, "cache")
    for _ in range(2):
        got = token_counts.count_tokens(docs, cache=cache)
        assert sorted((r.text, r.n_tokens) for r in got.collect()) == sorted((t, len(one_by_one("byte_bpe_50k.json", t))) for _, t in rows)
        assert spark.read.parquet(cache).select("content_digest").distinct().count() == 4


def test_long_texts(spark):
    rng = np.random.default_rng(3)
    long = " ".join("".join(rng.choice(list("abcdeé.,9"), rng.integers(1, 9))) for _ in range(120_000))
    docs = frame(spark, [long, "x" * 300_000, long[:70_000]])
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    assert got == {i: len(one_by_one("byte_bpe_50k.json", r.text)) for i, r in enumerate(docs.collect())}
    folder = work_path(spark, "t")
    token_files.write_token_files(docs, folder)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.read_index(spark, folder).collect()}
    assert got == {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, r in enumerate(docs.collect()) for ids in [[*one_by_one("word_bpe_49k.json", r.text), 1]]}
