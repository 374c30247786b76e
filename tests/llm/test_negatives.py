import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import negatives, queries

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("score", "rank", "w", "shard", "part")]])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA)


def brute(rows, every=100, relabel=True, k=5, n=5):
    known = set()
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        label = (label + 1) % 10 if relabel and vec_id % 7 == 0 else label
        known.add((vec_id, label, tuple(math.floor(256 * float(np.float32(c))) for c in v)))
    out = []
    for anchor, own, q in known:
        if anchor % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), i, label) for i, label, v in known))
        near = [(i, -s) for s, i, label in scored if label == own and i != anchor][:k]
        for p, ps in near:
            fit = [(i, -s) for s, i, label in scored if label != own and 80 * ps <= -100 * s <= 100 * ps][:n]
            out += [(anchor, p, r + 1, i, ps, s) for r, (i, s) in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute(rows)
    assert want and got(queries.op12_negatives(spark, sf)) == want


@pytest.mark.parametrize("options", [{}, {"sample": 16, "shard": 20, "block": 2}, {"sample": 1, "shard": 5, "block": 1}, {"sample": 64, "shard": 10_000}])
def test_small_parts_give_the_same(spark, options):
    rng = random.Random(2)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(400):
        m = rng.choice(middles)
        rows.append((i, [x + rng.gauss(0, 0.3) for x in m], rng.randrange(4)))
    rows += [(i, rows[3][1], rng.randrange(4)) for i in range(400, 520)]  # copies under other ids: ties
    rows += [rows[0], rows[100], (100, rows[7][1], 2), (200, rows[8][1], 1)]  # rows and ids that repeat
    assert got(negatives.mine(frame(spark, rows), F.col("vec_id") % 20 == 0, **options)) == brute(rows, 20, relabel=False)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (100, [0.0, 0.0], 1), (200, [-1.0, 0.25], 3), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (3, [1.0, 0.5], 2), (4, [1.0, 0.4], 0),
        (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 2), (8, [inf, 1.0], 2), (9, [1.0, 0.5], None), (None, [1.0, 0.5], 2), (10, [-inf, 0.0], 1), (300, [-3.0, 1.0], 5),
    ]
    want = brute(rows, relabel=False)
    assert want and got(negatives.mine(frame(spark, [*rows, (11, [1.0, 0.5, 9.0], 2), (12, [], 2)]), F.col("vec_id") % 100 == 0)) == want
    assert got(negatives.mine(negatives.relabelled(frame(spark, rows)), F.col("vec_id") % 100 == 0)) == brute(rows)
    assert got(negatives.mine(frame(spark, []), F.lit(True))) == []
    assert got(negatives.mine(frame(spark, [(1, [], 1), (2, None, 1)]), F.lit(True))) == []
    assert got(negatives.mine(frame(spark, rows), F.lit(None).cast("boolean"))) == []


def test_large_components_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.choice([-1, 1]) * rng.uniform(1e5, 4e5))) for _ in range(3)], rng.randrange(2)) for i in range(120)]
    assert got(negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, shard=16)) == brute(rows, 10, relabel=False)
    with pytest.raises(Exception, match="long|OVERFLOW|overflow"):
        negatives.mine(frame(spark, [(1, [1e30, 1.0], 1)]), F.lit(True)).collect()


numbers = st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=1, max_size=60)


@settings(max_examples=150, deadline=None)
@given(numbers, st.lists(st.integers(-6, 6), min_size=3, max_size=3), st.lists(st.tuples(st.integers(-60, 60), st.integers(0, 80)), min_size=1, max_size=4), st.integers(1, 4), st.integers(1, 8))
def test_traversal_is_brute_force(vectors, q, spans, k, bucket):
    v, q = np.array(vectors, np.int16), np.array(q)
    space = negatives.Space(int((v.astype(int) ** 2).sum(axis=1).max()), "<i2", np.float64)
    ids, fits = np.arange(len(v))[::-1].copy(), np.arange(len(v)) % 3 > 0
    windows = [negatives.Window_(a, a + n) for a, n in spans]
    found = negatives.nearest_first(space, negatives.Tree(space, v, bucket), v, ids, fits, q, windows, k)
    scored = sorted((-int(x @ q), int(i)) for x, i, f in zip(v.astype(int), ids, fits, strict=True) if f)
    assert found == [[(i, -s) for s, i in scored if w.low <= -s <= w.high][:k] for w in windows]


def test_traversal_leaves_parts_unopened():
    rng = np.random.default_rng(1)
    v = (rng.standard_normal((20, 6)).repeat(200, axis=0) * 300 + rng.standard_normal((4000, 6)) * 5).astype(np.int16)
    space = negatives.Space(int((v.astype(int) ** 2).sum(axis=1).max()), "<i2", np.float64)
    looked = []

    tree = negatives.Tree(space, v, 32)
    tree.leaf = [_Seen(x, looked) for x in tree.leaf]
    negatives.nearest_first(space, tree, v, np.arange(4000), np.ones(4000, bool), v[0].astype(int), [negatives.Window_(-(10**9), 10**9)], 5)
    assert sum(looked) < 2000


class _Seen(tuple):
    def __new__(cls, pair, looked):
        out = super().__new__(cls, pair)
        out.looked = looked
        return out

    def __iter__(self):
        self.looked.append(self[1] - self[0])
        return super().__iter__()
