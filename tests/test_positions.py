"""Places of matches, lines and numbers against plain Python."""

import random
import re

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import findings as R


def places(text, pattern):
    out = []
    for m in re.finditer(pattern, text):
        ahead = text[: m.start()]
        out.append((ahead.count("\n") + 1, m.start() - (ahead.rfind("\n") + 1) + 1, m.group()))
    return out


def test_matches_of_any_text_are_located(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab\n\n é😀x9 ") for _ in range(rng.choice([0, 1, 5, 60, 900]))) for _ in range(120)] + ["", "\n", "x9x9", "9\n9", "\n" * 300 + "x9" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").union(spark.createDataFrame([(-1, None)], "doc_id int, text string"))
    for pattern in (r"[x9]+", r"\n\n", r"a|b\n?", r"(?:é|😀)+x"):
        got = {}
        for r in R.located(df, pattern).orderBy("doc_id", "seq").collect():
            got.setdefault(r.doc_id, []).append((r.line, r.column, r.code))
        assert got == {i: places(t, pattern) for i, t in enumerate(texts) if re.search(pattern, t)}


def test_prefix_sums(spark):
    rng = random.Random(1)
    rows = [([rng.randrange(9) for _ in range(n)],) for n in (0, 1, 63, 64, 65, 129, 1000)]
    for r in spark.createDataFrame(rows, "x array<int>").select("x", T.prefix_sums(F.col("x")).alias("s")).collect():
        assert list(r.s) == [sum(r.x[: i + 1]) for i in range(len(r.x))]


def test_rows_are_numbered_without_one_task_a_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.randrange(200), i) for i in range(500)]
    df = spark.createDataFrame(rows, "kind string, user int, id int")
    got = {(r.id, r.place) for r in R.numbered(df, "kind", F.floor(F.col("user") / 10), "user", "id").collect()}
    want = set()
    for kind in "ab":
        want |= {(i, n + 1) for n, (_, i) in enumerate(sorted((u, i) for k, u, i in rows if k == kind))}
    assert got == want
