import random
import zlib

import numpy as np

from quarry.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in test) >= 0.97 * len(test)


def test_labels_of_held_out_rows_change_nothing(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(tuple, language.identify(docs).collect())) == sorted(map(tuple, language.identify(other).collect()))


def test_odd_texts(make, empty, odd_texts):
    rows = {r.doc_id: r for r in language.identify(make(odd_texts, langs=["en", None] * (len(odd_texts) // 2))).collect()}
    assert len(rows) == len(odd_texts)
    for i, t in enumerate(odd_texts):
        assert (rows[i].lang_pred == "und") == (not t or not any(c.isalpha() for c in t))
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(make(["abc", "def"], langs=[None, None])).collect()} == {"und"}


def grams(text):
    """The n-grams of 1 to 4 characters that a text holds."""
    t = text.lower()
    return {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}


def test_kernel_and_scores_are_those_of_sets_of_grams():
    """Presence kernel, Nystroem features and ridge regression by sets and a dense solve, against fit and scores."""
    rng = random.Random(11)
    words = {"en": "the of and in river stone walked slowly".split(), "de": "der die und nicht straße fluß gehen blau".split(), "fr": "le la et dans rivière pierre été lentement".split()}
    labels = [lang for lang in words for _ in range(10)]
    texts = [" ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 5))) for lang in labels]
    asked = [" ".join(rng.choice(words[rng.choice("en de fr".split())]) for _ in range(4)) for _ in range(12)] + ["x", "ÜBER die Straße", "zz zz zz"]
    flags = np.zeros(language.PLACES, np.uint8)
    held = {t: set(language.places(t, flags).tolist()) for t in texts + asked}
    # A place stands for a gram; few share one, so that the kernel is that of the sets of grams but for those.
    for t, p in held.items():
        assert len(p) <= len(grams(t)) <= len(p) + 2
    kernel = lambda a, b: len(held[a] & held[b]) / np.sqrt(len(held[a]) * len(held[b]))
    exact = lambda a, b: len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    assert max(abs(kernel(a, b) - exact(a, b)) for a in texts for b in asked) < 0.1
    m, ridge, n = 9, 1e-3, len(texts)
    turns, order = {}, []
    for i, lang in enumerate(labels):
        turns[lang] = turns.get(lang, -1) + 1
        order.append((turns[lang], i))
    marks = [texts[i] for _, i in sorted(order)[:m]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    good = values > 1e-8 * values.max()
    half = vectors[:, good] / np.sqrt(values[good])
    feature = lambda t: np.array([kernel(t, z) for z in marks]) @ half
    x = np.array([feature(t) for t in texts])
    langs = sorted(words)
    y = np.array([[1.0 if lang == c else -1.0 for c in langs] for lang in labels])
    f, g = x - x.mean(axis=0), y - y.mean(axis=0)
    w = np.linalg.solve(f.T @ f + ridge * n * np.eye(f.shape[1]), f.T @ g)
    want = np.array([(feature(t) - x.mean(axis=0)) @ w + y.mean(axis=0) for t in asked])
    images = np.zeros((n, language.PLACES), np.uint8)
    for i, t in enumerate(texts):
        images[i, list(held[t])] = 1
    model = language.fit(np.packbits(images, axis=1, bitorder="little"), labels, landmarks=m, ridge=ridge)
    got = language.scores(model, [np.array(sorted(held[t])) for t in asked])
    assert model.languages == tuple(langs) and np.abs(got - want).max() < 1e-4
