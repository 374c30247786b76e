import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import queries, runs


def brute(w, least, exponent):
    """(start, length, period) by comparing words a period apart, for each period."""
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i - s + p
            if i > s and n >= max(least, exponent * p) and all(any(w[s + k] != w[s + k + q] for k in range(n - q)) for q in range(1, p)):
                out.append((s, n, p))
            i += i == s
    return sorted(out, key=lambda x: (x[0], x[2]))


def collapse(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found(texts, least, exponent):
    sizes = np.array([len(t) for t in texts], np.int64)
    got = [[] for _ in texts]
    for t, *r in zip(*(x.tolist() for x in runs.find(np.array([x for t in texts for x in t], np.int64), sizes, least, exponent)), strict=True):
        got[t].append(tuple(r))
    return got


piece = st.lists(st.integers(0, 2), max_size=6)
text = st.lists(st.tuples(piece, st.integers(1, 7)), max_size=4).map(lambda parts: [x for p, n in parts for x in p * n])


@settings(max_examples=300, deadline=None)
@given(st.lists(text, max_size=4), st.sampled_from([(1, 2), (5, 2), (6, 3), (24, 3)]))
def test_runs_are_those_of_brute_force(texts, rule):
    assert found(texts, *rule) == [brute(t, *rule) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60))
def test_next_smaller(values):
    n = len(values)
    assert runs.next_smaller(np.array(values)).tolist() == [next((j for j in range(i + 1, n) if values[j] < values[i]), n) for i in range(n)]


def test_words_that_come_in_fibonacci_order():
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a
    assert found([b], 2, 2) == [brute(b, 2, 2)]


def test_long_texts_take_little_time():
    rng = random.Random(3)
    n = 200_000
    once, ends = [0] * n, [0, 1] * 1000 + [rng.randrange(5) for _ in range(n)]
    assert found([once, [], [i % 7 for i in range(n)]], 24, 3) == [[(0, n, 1)], [], [(0, n, 7)]]
    assert found([ends], 24, 3)[0][0][:1] == (0,)


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def expected(doc_id, text):
    w = planted(doc_id, text)
    r = brute(w, 24, 3)
    best = max(r, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in r)
    milli = 1000 * best[1] // best[2] if r else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(r), *best, milli, sha(lines), sha(collapse(w, r)))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 4000").collect()
    got = {r[0]: tuple(r) for r in queries.op11_runs(spark, sf).collect()}
    assert len(got) >= len(docs)
    for d in docs:
        assert got[d[0]] == expected(*d)


@pytest.mark.parametrize("ids", [None, "null", "same"])
def test_cases(make, odd_texts, ids):
    texts = [*odd_texts[:14], *odd_texts[15:], "a b " * 40, "z " * 24, "q " * 23, "a b c " * 8 + "a b", "é\x1cx\xa0 " * 30]
    known = list(range(len(texts))) if ids is None else [None if ids == "null" else 7] * len(texts)
    docs = make(texts, ids=known)
    got = rows(runs.digests(runs.runs(runs.planted(docs))))
    assert got == sorted((expected(d, t) for d, t in zip(known, texts, strict=True)), key=repr)


def test_empty_table(empty):
    assert runs.digests(runs.runs(runs.planted(empty))).collect() == []


def test_many_groups_in_a_batch(make):
    texts = [f"w{i % 3} " * (i % 40) + "x y " * (i % 30) for i in range(200)]
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in runs.runs(make(texts)).collect()}
    whole = runs._group([t.encode() for t in texts], 24, 3).to_pylist()
    assert [got[i] for i in range(200)] == [brute(t.split(), 24, 3) for t in texts] == [[tuple(x.values()) for x in r["runs"]] for r in whole]


def test_rule_is_checked(empty):
    with pytest.raises(ValueError):
        runs.runs(empty, exponent=1)
