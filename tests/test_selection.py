"""Order statistics against sorting."""

import math
import random

import pytest

from quarry.operators.selection import at_shares

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


def values(kind):
    rng = random.Random(kind)
    return {
        "few": [rng.choice([1.0, 2.0, 5.0]) for _ in range(500)], "one": [3.5] * 40, "two": [1.0, 2.0], "many": [rng.random() for _ in range(5000)],
        "far": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 308) for _ in range(800)], "hot": [7.0] * 900 + [rng.gauss(7, 1e-9) for _ in range(300)], "signs": [0.0, -0.0, -1.0, 1.0] * 9,
        "odd": [float("nan"), None, 1.0, None, 2.0, float("nan"), 3.0],
    }[kind]


@pytest.mark.parametrize("kind", ["few", "one", "two", "many", "far", "hot", "signs", "odd"])
def test_selection_is_sorting(spark, kind):
    vs = values(kind)
    known = sorted(v for v in vs if v is not None and not math.isnan(v))
    n, found = at_shares(spark.createDataFrame([(v,) for v in vs], "v double"), "v", SHARES)
    assert n == len(known) and found == [known[min(n - 1, math.floor(n * s))] for s in SHARES]


def test_nothing_to_select_from(spark):
    assert at_shares(spark.createDataFrame([(None,)], "v double"), "v", SHARES) == (0, [None] * len(SHARES))
