"""Language identification with string kernels.

Kernel.  Two texts are compared by the n-grams of 1 to 4 characters that both hold (presence, blended over n), divided by the root of
the product of their counts. An n-gram is known by its hash in 2**17 places.

Nystroem.  Some of the labelled sample's texts are landmarks Z. With K the kernel, a text x has the features K(x, Z) K(Z, Z)**-1/2.

Classifier.  One kernel ridge regression a language on targets +1 and -1, solved on those features. As K(x, Z) is a product of
presence rows, scores for a batch are P (Z' A), P holding the batch's presence rows: Z' A is multiplied out once, and a batch is
scored by one (sparse) matrix product.

The sample that is learned from has at most ``most`` rows, an equal number a language as far as there are, chosen by a hash of the
id; it is the only thing that reaches the driver, as bitmaps of 16 KB each, whatever the texts' lengths.

Cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if nothing can be learned from; ties
between languages go to the first by code point; rows with a null id are classified, but not learned from (held_out false); rows
stay one to one with the input, repeated or not; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import cut, held, small_batches, tidy

#: Languages whose counts may be broadcast, a few dozen bytes each.
MOST_BROADCAST = 100_000
BITS = 17
PLACES = 1 << BITS
GRAMS = 4
_BLOCK = 8192


def places(text: str, flags: np.ndarray) -> np.ndarray:
    """The places of a text's n-grams, ascending. flags: a zeroed array of PLACES bytes, zeroed again at return."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    h = c
    for n in range(1, GRAMS + 1):
        if n > 1:
            h = h[:-1] * np.uint32(0x9E3779B1) + c[n - 1 :]
            if not len(h):
                break
        x = (h ^ np.uint32(n * 0x7F4A7C15 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        flags[(x * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)] = 1
    out = np.flatnonzero(flags)
    flags[out] = 0
    return out


class Model(NamedTuple):
    languages: tuple[str, ...]
    weights: np.ndarray  # PLACES x languages: landmarks times dual coefficients
    bias: np.ndarray


def fit(rows: np.ndarray, labels: list[str], landmarks: int = 128, ridge: float = 1e-3) -> Model:
    """rows: packed bitmaps, a row each. The first rows of each language serve as landmarks, so order them by a hash."""
    languages = tuple(sorted(set(labels)))
    y = np.array([[1.0 if x == c else -1.0 for c in languages] for x in labels])
    turn: dict[str, int] = {}
    order = []
    for i, x in enumerate(labels):
        turn[x] = turn.get(x, -1) + 1
        order.append((turn[x], i))
    z = np.array([i for _, i in sorted(order)[:landmarks]])
    n, m = len(labels), len(z)
    common, sizes = np.zeros((n, m)), np.zeros(n)
    for at in range(0, PLACES, _BLOCK):
        part = np.unpackbits(rows[:, at // 8 : (at + _BLOCK) // 8], axis=1, bitorder="little").astype(np.float32)
        sizes += part.sum(axis=1)
        common += part @ part[z].T
    root = np.sqrt(np.maximum(sizes, 1))
    k = common / root[:, None] / root[z][None, :]
    values, vectors = np.linalg.eigh(k[z])
    good = values > 1e-8 * values.max()
    half = vectors[:, good] / np.sqrt(values[good])
    features = k @ half
    mean_f, mean_y = features.mean(axis=0), y.mean(axis=0)
    f = features - mean_f
    solved = np.linalg.solve(f.T @ f + ridge * n * np.eye(f.shape[1]), f.T @ (y - mean_y))
    dual = (half @ solved) / root[z][:, None]
    weights = np.zeros((PLACES, len(languages)), np.float32)
    for at in range(0, PLACES, _BLOCK):
        part = np.unpackbits(rows[z][:, at // 8 : (at + _BLOCK) // 8], axis=1, bitorder="little")
        weights[at : at + _BLOCK] = part.T.astype(np.float64) @ dual
    return Model(languages, weights, (mean_y - mean_f @ solved).astype(np.float64))


def scores(model: Model, found: list[np.ndarray]) -> np.ndarray:
    """A batch's values for each language: its presence rows, as lists of places, times the weights (a sparse matrix product)."""
    ends = np.cumsum([len(x) for x in found])
    starts = np.concatenate([[0], ends[:-1]])
    raw = np.add.reduceat(model.weights[np.concatenate(found)], starts, axis=0, dtype=np.float64)
    return raw / np.sqrt(ends - starts)[:, None] + model.bias


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, most: int = 1024, landmarks: int = 128, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model | None:
    """Fit on a bounded sample of the labelled rows that aren't held out; None if there are none."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    known = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # Ids alone are drawn. Of a language's n rows those whose place by hash lies under 4 * most / n are ranked, so that no task sorts
    # all rows of a frequent language.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    ids = known.select("doc_id", "lang", place.alias("place"))
    # One row a language; a language code is no free text, and more of them than this are no languages.
    counts = cut(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), light=True)
    near = F.broadcast(counts) if counts.count() <= MOST_BROADCAST else counts
    few = ids.join(near, "lang").where(F.col("place") * F.col("n") < 4.0 * most * (1 << 32))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("place", "doc_id"))
    chosen = few.dropDuplicates(["lang", "place", "doc_id"]).withColumn("rank", rank).where(F.col("rank") <= most).orderBy("rank", "lang").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(PLACES, np.uint8)
        for b in batches:
            images = []
            for x in b.column(2):
                row = np.zeros(PLACES, np.uint8)
                row[places(x.as_py(), flags)] = 1
                images.append(np.packbits(row, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(images, pa.binary())], ["rank", "lang", "image"])

    # Of rows that repeat an id and language the text with the smallest hash speaks for all, so that a draw is one row.
    drawn = known.where("text is not null").join(F.broadcast(chosen.select("doc_id", "lang", "rank")), ["doc_id", "lang"])
    sample = drawn.groupBy("rank", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = sample.mapInArrow(run, "rank int, lang string, image binary").toArrow()
    if not found.num_rows:
        return None
    found = found.sort_by([("rank", "ascending"), ("lang", "ascending")])
    images = np.frombuffer(b"".join(found.column("image").to_pylist()), np.uint8).reshape(-1, PLACES // 8)
    return fit(images, found.column("lang").to_pylist(), landmarks)


def classifier(model: Model | None) -> Callable[[Column], Column]:
    """A function from a text column to struct(lang_pred, score). Texts alone go to Python, and nothing but results comes back."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        held("language")
        letter = regex.compile(r"\p{L}").search
        flags = np.zeros(PLACES, np.uint8)
        for turn, whole in enumerate(batches):
            if turn % 16 == 0:
                tidy()
            parts = []
            for first in range(0, len(whole), 256):
                b = whole.slice(first, 256)
                n = len(b)
                found, rows = [], []
                for i, x in enumerate(b):
                    x = x.as_py()
                    if model is not None and x and letter(x):
                        found.append(places(x, flags))
                        rows.append(i)
                best, score = ["und"] * n, np.zeros(n)
                if rows:
                    values = scores(model, found)
                    top = values.argmax(axis=1)
                    for i, k in zip(rows, top.tolist(), strict=True):
                        best[i] = model.languages[k]
                    score[rows] = np.clip((values[np.arange(len(rows)), top] + 1) / 2, 0, 1)
                parts.append(pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score)], ["lang_pred", "score"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    small_batches()
    # Not deterministic to the optimizer, so that a filter on the result doesn't classify twice.
    return F.arrow_udf(run, "struct<lang_pred:string,score:double>").asNondeterministic()


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred and score (0 to 1) for each row; only the text is looked at."""
    found = docs.select(F.struct(*keep).alias("row"), classifier(model)(F.col(text).cast("string")).alias("found"))
    return found.select(*(F.col("row")[c].alias(c) for c in keep), "found.lang_pred", "found.score")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows that aren't held out, and predict for all: doc_id, held_out, lang_pred, score."""
    out = predict(docs, learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
