"""Places of extracted strings against trying every span, and framed inputs of rerankers against a tokenizer."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skein.functions import providers
from skein.functions.framing import Framer, tokenizer_file
from skein.functions.grounding import places
from skein.operators import chunking, mentions


def test_words_are_not_found_in_others():
    text = "Annapolis is where Ann  Lee was; ANN LEE and ann-lee left Annapolis"
    assert places(text, ["Ann", "ann lee", "Ann Lee", "ann lee", "Lee Ann", "Bob", ""]) == [(19, 22), (19, 27), (19, 27), (33, 40), (24, 27), None, None]
    assert places(text, ["Annapolis"] * 3) == [(0, 9), (58, 67), (58, 67)]
    assert places("the Grand old Duke of York", ["Grand Old Dukes York"]) == [(4, 13)] and places("the Grand old Duke", ["Grand Old Dukes of York"]) == [None]
    assert places("a b c", ["x y b"]) == [None] and places("a b c", ["x b"]) == [(2, 3)]
    assert places("++ is no word, c++ is", ["++", "c++", "C++"]) == [(0, 2), (15, 18), (15, 16)]


def slow(text, name, share=0.5):
    """All places of a name by trying every span of whole words."""
    word = [(m.start(), m.end()) for m in re.finditer(r"\w+", text)]
    want = [w.lower() for w in re.findall(r"\w+", name)]
    spans = [(a, b) for i, (a, _) in enumerate(word) for _, b in word[i:]]

    def apart(found):
        out = []
        for p in sorted(found):
            if not out or p[0] >= out[-1][1]:
                out.append(p)
        return out

    exact = apart([p for p in spans if text[p[0] : p[1]] == name])
    if exact:
        return exact
    for n in range(len(want), 0, -1):
        if n < len(want) and n < share * len(want):
            return []
        for k in range(len(want) - n + 1):
            got = apart([p for p in spans if [w.lower() for w in re.findall(r"\w+", text[p[0] : p[1]])] == want[k : k + n]])
            if got:
                return got
    return []


def test_places_are_those_of_every_span():
    r = random.Random(9)
    words = ["ann", "Ann", "lee", "LEE", "bay", "of", "annex"]
    for _ in range(400):
        text = "".join(r.choice(words) + r.choice([" ", "  ", "-", ", "]) for _ in range(r.randrange(0, 9)))
        name = " ".join(r.choice(words) for _ in range(r.randrange(1, 5)))
        want = slow(text, name)
        assert places(text, [name] * 3) == [want[min(k, len(want) - 1)] if want else None for k in range(3)], (text, name)


def test_records_are_grounded_by_their_place(spark):
    units = spark.createDataFrame([("p", "s", "Annapolis is where Ann Lee was"), ("p", "t", None)], "passage_id string, su_id string, text string")

    def extract(texts):
        return [[{"text": "Ann", "type": "person", "description": "x"}, {"text": "nobody", "type": "person", "description": "y"}, {"text": "at", "start": 3, "end": 5, "type": "place", "description": "given"}] for _ in texts]

    found = providers.extraction_provider(extract)(units)
    assert {(r.su_id, r.surface_text, r.char_start, r.char_end) for r in found.collect()} == {("s", "Ann", 19, 22), ("s", "nobody", None, None), ("s", "at", 3, 5), ("t", "Ann", None, None), ("t", "nobody", None, None), ("t", "at", 3, 5)}
    assert {(r.su_id, r.normalized_name, r.grounded) for r in mentions.mention_records(found).collect()} == {("s", "ann", True), ("s", "nobody", False), ("t", "ann", False), ("t", "nobody", False)}


def test_frames_keep_to_their_budget(spark):
    import public_tokenizers

    encode = tokenizer_file(public_tokenizers.path("byte_bpe_50k.json"))
    framer = Framer(encode, 24, (7, 8), (9,), pad=5)
    pairs = ["short", "a much longer pair " * 20, "", None, "x " * 21]
    ids, mask = framer.padded(pairs)
    for p, row, m in zip(pairs, ids.tolist(), mask.tolist(), strict=True):
        want = [7, 8, *encode(p or "")[:21], 9]
        pad = len(row) - len(want)
        assert row == [5] * pad + want and m == [0] * pad + [1] * len(want)
    assert ids.shape[1] == 24
    rows = spark.createDataFrame([(p,) for p in pairs], "p string").select(framer.framed(F.col("p")).alias("ids")).collect()
    assert [r.ids for r in rows] == [framer.frame(p) for p in pairs]
    with pytest.raises(ValueError, match="no room"):
        Framer(encode, 2, (1, 2), (3,))
    assert framer.padded([])[0].shape == (0, 0)


def test_a_reranker_gets_ids(spark):
    framer = Framer(lambda t: [len(w) for w in t.split()], 60, (1,), (2,))

    def score(ids, mask):
        if (ids == 13).any():
            raise RuntimeError("bad pair")
        assert ids.shape == mask.shape and ids.shape[1] <= 60 and (ids[:, -1] == 2).all()
        return mask.sum(1)

    rows = spark.createDataFrame([("q", "one two"), ("q", "one two three four five six seven"), ("thirteenchars", "bad")], "q string, p string")
    got = [r[0] for r in rows.coalesce(1).select(providers.pair_provider(score, framer)(F.col("q"), F.col("p"))).collect()]
    assert got[1] > got[0] > 0 and got[2] == 0


def test_chunks_by_a_given_token_count(spark):
    text = " ".join(f"This is sentence number {i} of the text." for i in range(40))
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    words, letters = (chunking.semantic_chunks(docs, "id", "text", 60, count=c).collect() for c in (None, len))
    assert len(letters) > len(words) > 1
    assert all(" ".join(r.text for r in sorted(x, key=lambda r: r.chunk_no)) == text for x in (words, letters))
    assert max(len(r.text) for r in letters) <= 72
