import random

import pytest
from pyspark.sql import types as T

#: The columns of documents, and columns whose names clash with what operators make.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("size", "ids", "bucket", "spans", "found", "band", "node", "k", "__text", "rank", "n")],
    ]
)


def prose(rng: random.Random, n: int, words=None) -> str:
    words = words or ["the", "of", "and", "in", "river", "stone", "walked", "slowly", "blue", "a", "houses", "naïve", "straße"] + [f"w{i}" for i in range(300)]
    return " ".join(rng.choice(words) for _ in range(n))


def rows(texts, ids=None, sources=None, langs=None):
    out = []
    for i, t in enumerate(texts):
        d = i if ids is None else ids[i]
        out.append((d, t, (langs or ["en"] * len(texts))[i], (sources or ["a"] * len(texts))[i], None, *["x"] * 11))
    return out


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, **k: spark.createDataFrame(rows(texts, **k), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, no letters, ties, copies, near copies, a long text."""
    rng = random.Random(5)
    base = prose(rng, 200)
    near = base.split()
    near[100] = "changed"
    passage = prose(rng, 60)
    return [
        None, "", "   \n\t ", "12 34 $$ %%", "one", "two words", "two words", base, base, " ".join(near), base.upper(), "x " * 400,
        prose(rng, 30) + " " + passage + " " + prose(rng, 40), prose(rng, 35) + "\n" + passage, prose(rng, 20_000), None,
        "line one is here\nline one is here\n\nline  two  is here\r\nend", "日本語 のテキスト です 😀 é é", "a\x1cb\xa0c d", "tail  \n",
    ]
