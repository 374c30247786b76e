import random
import re

import pytest

from quarry.llm import mixing
from tests.llm.conftest import prose


def targets(sizes):
    """Sharing again and again, as the rule is worded."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        for s in full or open_:
            out[s] = 2 * sizes[s] if full else left * weight[s] / total
        if not full:
            break
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_mix_meets_its_targets(make, empty, odd_texts):
    rng = random.Random(8)
    texts = odd_texts + [prose(rng, rng.choice([1, 5, 40, 200, 900])) for _ in range(300)]
    sources = [rng.choice(["hot"] * 8 + ["b", "c", "Z", "é", None, "d"]) for _ in texts]
    texts, sources = [*texts, " ", None], [*sources, "nothing", "nothing"]
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    total = {s: sum(n for n, x in zip(size, sources, strict=True) if x == s) for s in set(sources)}
    want = targets(total)
    rows = mixing.mix(make(texts, sources=sources)).collect()
    assert sorted((r.doc_id, r.size) for r in rows) == sorted(enumerate(size))
    taken = dict.fromkeys(total, 0)
    for r in rows:
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in total)
    again = mixing.mix(make(texts, sources=sources).repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix(empty).count() == 0


def test_rates_are_exponential_in_size(make):
    import math

    rng = random.Random(1)
    rows = [r for r in mixing.mix(make([prose(rng, rng.randint(1, 300)) for _ in range(200)], sources=["a", "b"] * 100)).collect() if 0 < r.rate < 2 and r.source == "b"]
    slopes = [math.log(r.rate) / r.size for r in rows]
    assert max(slopes) - min(slopes) < 1e-9


def test_materialized_words_are_those_taken(make):
    docs = make(["a b c d", "e f", "g h i", None, "j k l m n o p"], sources=["x", "x", "y", "y", None])
    plan = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.materialize(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {d: n for d, n in plan.items() if n}


def test_no_python_on_the_path(make):
    assert "Python" not in mixing.mix(make(["a b", "c"]))._jdf.queryExecution().executedPlan().toString()
