"""Reassembled conversations against a replay in plain Python."""

import hashlib
import random

import pytest

from skein.llm import queries as registry
from skein.llm import turns

KIND = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(rows):
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows if t is not None]
    first, arrive = {}, {}
    for c, t, role, text in rows:
        first[c] = min(first.get(c, t), t)
        h = int(sha(f"{'null' if c is None else c}:{t}")[:8], 16)
        for b, said in [(h % 8, role)] + [((h + 3) % 8, "user")] * (h % 7 < 2):
            payload = (f"{said}|{text}".encode(), said)
            now = arrive.setdefault(b, {})
            now[c, t] = min(now.get((c, t), payload), payload)
    kept, upto, last, closed, out = {}, {}, {}, set(), []

    def close(c, b):
        own = kept[c]
        left = [t for t in sorted(own) if t >= upto[c]]
        breaks = sum(t - 1 in own and own[t - 1][1] == own[t][1] for t in own)
        out.append(("close", c, -1, b, sha(",".join(map(str, left))), max(own) - first[c] + 1 - len(own), breaks))
        closed.add(c)

    for b in range(8):
        for (c, t), p in arrive.get(b, {}).items():
            if c in closed:
                out.append(("reject", c, t, b, hashlib.sha256(p[0]).hexdigest(), None, None))
            else:
                kept.setdefault(c, {}).setdefault(t, p)
                upto.setdefault(c, first[c])
                last[c] = b
        for c, own in kept.items():
            while c not in closed and upto[c] in own:
                out.append(("release", c, upto[c], b, hashlib.sha256(own[upto[c]][0]).hexdigest(), None, None))
                upto[c] += 1
        for c in last:
            if c not in closed and last[c] == b - 3:
                close(c, b)
    for c in last:
        if c not in closed:
            close(c, 8)
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("event", "conv_id", "turn", "batch", "sha256", "n_missing", "n_breaks").collect()), key=str)


def table(n, seed):
    r = random.Random(seed)
    out = []
    for c in range(n):
        start = r.choice([0, 0, 3, -2])
        for t in range(start, start + r.randrange(1, 12)):
            if r.random() < 0.9:
                out += [(c, t, r.choice(["user", "assistant", None, ""]), r.choice([f"said {t}", "é", None, "", "a|b"]))] * r.choice([1, 1, 1, 2])
                if r.random() < 0.1:
                    out.append((c, t, "user|a", "b"))
    return [*out, (None, 2, "user", "x"), (None, 3, "user", "y"), (5, None, "user", "dropped"), (None, None, None, None)]


@pytest.mark.parametrize(("n", "buckets"), [(150, 6), (3, 2)])
def test_events(spark, n, buckets):
    rows = table(n, n)
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as batch", "'x' as bucket", "'y' as first").repartition(3)
    want = expected(rows)
    assert got(turns.reassemble(docs, buckets=buckets)) == want
    assert n < 100 or {e[0] for e in want} == {"release", "reject", "close"} and {e[3] for e in want if e[0] == "close"} > {3, 8}


def test_one_long_conversation_and_none(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", "long " * (50_000 if t == 7 else 1)) for t in range(900) if t != 450]
    assert got(turns.reassemble(spark.createDataFrame(rows, KIND), buckets=3)) == expected(rows)
    assert turns.reassemble(spark.createDataFrame([], KIND), buckets=2).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(registry.QUERIES["op13_turns"](spark, sf)) == expected(rows)
