"""Pairs of sets against all pairs."""

import random

from quarry.operators import similarity as S


def test_pairs_of_sets_are_those_of_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    for above, size, few in ((0.5, 7, 16), (0.2, 7, 5)):
        base = [[rng.randrange(60) for _ in range(rng.randrange(size))] for _ in range(40)]
        sets = {i: set(rng.choice(base)) | ({rng.randrange(60)} if rng.random() < 0.5 else set()) for i in range(120)}
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) > above * len(sets[a] | sets[b])}
        got = [(r.a, r.b) for r in S.jaccard_pairs(spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id long, s array<long>"), above, few).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_sets_that_share_one_element_do_not_meet(spark, monkeypatch):
    """2,000 sets of four have one element in common, the rest alone."""
    kept, seen = S.checkpointed, []
    monkeypatch.setattr(S, "checkpointed", lambda df: seen.append(kept(df)) or seen[-1])
    rows = [(i, [0, *(10 * i + k for k in (1, 2, 3))]) for i in range(2000)] + [(5000, [0, 1, 2, 9])]
    assert [tuple(r) for r in S.jaccard_pairs(spark.createDataFrame(rows, "id long, s array<long>"), 0.5).collect()] == [(0, 5000, 0.6)]
    assert seen[-1].count() == 1
