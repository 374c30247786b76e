"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Lists.  A k-means over a bounded sample (``sample`` rows) gives centroids; every vector goes to its nearest one. A query looks into
the lists whose inner product with it can be largest: centroid's product plus the query's length times the list's usual radius.

Codes.  A vector v of list c has the residual r = v - c. Rotated by one random rotation and scaled to length 1, it is kept as the signs
of its parts, packed to words of 64 bits, with two scalars: the residual's length, and the product of the residual with its own code.
A query's rotated parts are rounded to ``PLANES`` bits and kept as bit planes, so that <code, q'> is a sum of population counts of
code and plane; nothing is unpacked. <v, q> is estimated as <c, q> + |r| <code, q'> / <code, r'>. The error is at most
e |r| |q| sqrt((1 - p^2) / p^2 / (D - 1)) with p = <code, r'>, and e times the rounding's, but for a probability that falls fast with e
(``slack``). Vectors whose upper bound reaches the k-th best lower bound of their block are ranked again by their exact product on the
original vectors.

A query's 2k-th best product among the sample's rows in its lists is a floor: a block returns only what reaches it, at most k rows a
query. Where an error bound fails, a query may get fewer rows than there are; it looks into all lists then, without floor and bound.

Work is dealt in units of a shard of vectors and a block of queries. Vectors lie in order of their lists (sorted along the main
axis of the centroids), shards of ``block`` rows cut that order, queries lie in the order of their nearest list, and a unit exists
only if a query of the block looks into a list of the shard. A query is sent once to a shard, not once to each of its lists, and a
vector once to a block of queries. Vectors travel beside their codes: at 64 parts a bound leaves several hundredths of a shard, so
that fetching vectors by id afterwards would move more than the shard does. The slowest step grows with vectors times queries.

``probe=1, slack=float("inf")`` is exact: all lists, and every vector ranked by its product.

Cases: vectors that are null, zero, of another dimension than most or that hold null or non-finite parts take no part, nor do rows
without an id; ties go to the smaller id; a query is no candidate of its own, nor is any row with its id; rows repeated under other
ids are found each; rows of one id are one query and one neighbour, at the best score of their vectors; ids that aren't numbers are
null by the cast to long (an error under ANSI rules); an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import cut


class Index(NamedTuple):
    """What is fitted: centroids, the radius of each list in the sample, and the rotation."""

    centroids: np.ndarray
    radius: np.ndarray
    rotation: np.ndarray


def usable(vector: Column) -> Column:
    """Whether a vector can take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit(sample: np.ndarray, lists: int, steps: int = 10, seed: int = 7) -> Index:
    """Plain k-means from sample rows evenly spaced in their (hashed) order."""
    n, d = sample.shape
    lists = max(1, min(lists, n))
    centroids = sample[np.linspace(0, n - 1, lists).astype(int)].copy()
    for _ in range(steps):
        near = assign(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        count = np.bincount(near, minlength=lists)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    off = centroids - centroids.mean(axis=0)
    axis = np.linalg.svd(off, full_matrices=False)[2][0] if lists > 1 else np.ones(d)
    centroids = centroids[np.argsort(off @ axis, kind="stable")]
    near = assign(sample, centroids)
    away = np.linalg.norm(sample - centroids[near], axis=1)
    radius = np.bincount(near, away, minlength=lists) / np.maximum(np.bincount(near, minlength=lists), 1)
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    return Index(centroids, radius, rotation)


def assign(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(axis=1) / 2
    return np.concatenate([(vectors[i : i + 4096] @ centroids.T - half).argmax(axis=1) for i in range(0, len(vectors), 4096)] or [np.empty(0, np.int64)])


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as words of 64 bits."""
    n, d = bits.shape
    out = np.zeros((n, -(-d // 64) * 8), np.uint8)
    out[:, : -(-d // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return out.view("<u8")


def encode(vectors: np.ndarray, near: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, residual lengths, and products of code and residual."""
    rest = (vectors - index.centroids[near]) @ index.rotation
    length = np.linalg.norm(rest, axis=1)
    unit = rest / np.maximum(length, 1e-300)[:, None]
    own = np.abs(unit).sum(axis=1) / np.sqrt(rest.shape[1])
    return packed(rest > 0), length, np.maximum(own, 1e-12)


#: Bits that a part of a rotated query is rounded to.
PLANES = 6


class Planes(NamedTuple):
    """Rotated queries as bit planes: part = least + step * (sum of 2**j * bit j)."""

    words: np.ndarray  # queries x PLANES x words
    least: np.ndarray
    step: np.ndarray
    total: np.ndarray


def planes(turned: np.ndarray) -> Planes:
    least = turned.min(axis=1)
    step = np.maximum(turned.max(axis=1) - least, 1e-300) / (2**PLANES - 1)
    levels = np.rint((turned - least[:, None]) / step[:, None]).astype(np.uint8)
    words = np.stack([packed((levels >> j & 1).astype(bool)) for j in range(PLANES)], axis=1)
    return Planes(words, least, step, turned.sum(axis=1))


def code_products(codes: np.ndarray, ones: np.ndarray, p: Planes, d: int) -> np.ndarray:
    """<code, q'> for all queries and codes, from population counts alone; ones: the codes' own counts."""
    counts = np.zeros((len(p.least), len(codes)), np.uint32)
    for j in range(PLANES):
        for w in range(codes.shape[1]):
            counts += np.left_shift(np.bitwise_count(p.words[:, j, w, None] & codes[None, :, w]), j, dtype=np.uint32)
    inside = p.least[:, None] * ones[None, :] + p.step[:, None] * counts
    return (2 * inside - p.total[:, None]) / np.sqrt(d)


def _matrix(column) -> np.ndarray:
    data = b"".join(column)
    return np.frombuffer(data, np.float64).reshape(len(column), -1)


_FOUND = {"query_id": "int64", "vec_id": "int64", "score": "float64"}


def search_block(v: pd.DataFrame, q: pd.DataFrame, index: Index, k: int, slack: float) -> pd.DataFrame:
    """The k best of a shard's vectors for each of a block's queries (query_id, vec_id, score), in lists that the query looks into."""
    if not len(v) or not len(q):
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in _FOUND.items()})
    vectors, queries, ids, near = _matrix(v["vector"]), _matrix(q["vector"]), v["vec_id"].to_numpy(), v["list"].to_numpy()
    d, exact_only = vectors.shape[1], slack == np.inf
    codes = np.frombuffer(b"".join(v["code"]), "<u8").reshape(len(v), -1)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    held, at_list = np.unique(near, return_inverse=True)
    length, own = v["length"].to_numpy(), v["own"].to_numpy()
    scale = length / own
    spread = (1 - np.minimum(own, 1) ** 2) / max(d - 1, 1)
    probes = np.unpackbits(np.stack(q["probes"]).astype("<i8").view(np.uint8), axis=1, bitorder="little")[:, held].astype(bool)
    names, floors = q["query_id"].to_numpy(), q["floor"].to_numpy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), 64):
        part, open_ = queries[at : at + 64], probes[at : at + 64][:, at_list]
        open_ &= ids[None, :] != names[at : at + 64, None]
        if not exact_only:
            turned = part @ index.rotation
            p = planes(turned)
            guess = (part @ index.centroids[held].T)[:, at_list] + code_products(codes, ones, p, d) * scale[None, :]
            # Rounding moves each part by at most half a step, evenly: its variance is a twelfth of the step's square.
            error = slack * scale[None, :] * np.sqrt(np.square(part).sum(axis=1)[:, None] * spread[None, :] + np.square(p.step)[:, None] / 12)
            low = np.where(open_, guess - error, -np.inf)
            bar = np.partition(low, -k, axis=1)[:, -k] if len(v) > k else np.full(len(part), -np.inf)
            open_ &= guess + error >= np.maximum(bar, floors[at : at + 64])[:, None]
        for i, name in enumerate(names[at : at + 64].tolist()):
            keep = np.flatnonzero(open_[i])
            exact = (vectors[keep] * part[i]).sum(axis=1)
            reach = exact >= floors[at + i]
            keep, exact = keep[reach], exact[reach]
            best = np.lexsort((ids[keep], -exact))[:k]
            out.append((np.full(len(best), name), ids[keep][best], exact[best]))
    a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame({"query_id": a, "vec_id": b, "score": c}).astype(_FOUND)


def nearest(
    table: DataFrame, is_query: Column, k: int = 20, probe: float = 0.8, least_probe: int = 16, per_list: int = 256, most_lists: int = 4096, sample: int = 20_000,
    block: int = 16_384, query_block: int = 4096, slack: float = 2.5, vector: str = "embedding", vec_id: str = "vec_id",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product for each row where is_query holds."""
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return empty
    d, n = common
    rows = rows.where(F.size("v") == d)
    # An id with m vectors may take m places, so that m times as many rows are looked for.
    per_id = lambda: rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m").alias("m"), F.count(F.lit(1)).alias("ids")).first()
    most, n_ids = per_id()
    if most > 1:
        rows = cut(rows.dropDuplicates(["vec_id", "v"]))
        n, most = rows.count(), per_id()[0]
    wide = k * most
    # A sample of bounded size, in the order of a hash: the only vectors that reach the driver.
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // (2 * sample)))) == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    got = drawn.select("vec_id", "v").collect()
    fitted, fitted_ids = np.array([r.v for r in got]), np.array([r.vec_id for r in got], np.int64)
    index = fit(fitted, min(most_lists, max(1, n // per_list)))
    fitted_lists = assign(fitted, index.centroids)
    lists, longest = len(index.centroids), float(np.linalg.norm(fitted, axis=1).max())
    probes = min(lists, max(least_probe, int(np.ceil(probe * lists))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            near = assign(m, index.centroids)
            bits, length, own = encode(m, near, index)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(near.astype(np.int32)), pa.array([x.tobytes() for x in m], pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(length), pa.array(own)],
                ["vec_id", "list", "vector", "code", "length", "own"],
            )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
                ids, norm = b.column(0).to_numpy(), np.linalg.norm(m, axis=1)
                hope = m @ index.centroids.T + norm[:, None] * index.radius[None, :]
                best = np.argsort(-hope, axis=1, kind="stable")[:, :probes]
                asked = np.zeros((len(ids), lists), bool)
                asked[np.arange(len(ids))[:, None], best] = True
                near = m @ fitted.T
                # Only rows that the query will meet count, so that enough reach the floor.
                near[(ids[:, None] == fitted_ids[None, :]) | ~asked[:, fitted_lists]] = -np.inf
                # The 2k-th, as an error bound may fail for some; a hair lower, as last digits depend on the order of additions.
                floor = np.partition(near, -2 * wide, axis=1)[:, -2 * wide] if near.shape[1] >= 2 * wide else np.full(len(ids), -np.inf)
                yield _asked(ids, assign(m, index.centroids), m, floor - 1e-9 * norm * longest, asked)

    def look_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            yield _asked(b.column(0).to_numpy(), assign(m, index.centroids), m, np.full(b.num_rows, -np.inf), np.ones((b.num_rows, lists), bool))

    codes = cut(rows.select("vec_id", "v").mapInArrow(code, "vec_id long, list int, vector binary, code binary, length double, own double"))
    before = W.orderBy("list").rowsBetween(W.unboundedPreceding, -1)

    def placed(df: DataFrame, key: str, size: int) -> tuple[DataFrame, DataFrame]:
        """df with its block in order of lists, and for each list its first and last block: a row a list, at most ``most_lists``."""
        counts = df.groupBy("list").agg(F.count(F.lit(1)).alias("m")).withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0)))
        place = F.col("start") + F.pmod(F.xxhash64(key), F.col("m"))
        ends = counts.select("list", F.floor(F.col("start") / size).alias("first"), F.floor((F.col("start") + F.col("m") - 1) / size).alias("last"))
        return df.join(F.broadcast(counts), "list").withColumn("at", F.floor(place / size).cast("long")).drop("m", "start"), ends

    shards, ends = placed(codes, "vec_id", block)
    shards = shards.withColumnRenamed("at", "shard")

    def found(asked: DataFrame, slack: float) -> DataFrame:
        asked = cut(placed(cut(asked), "query_id", query_block)[0].withColumnRenamed("at", "turn"))
        # Which lists a block of queries looks into: its queries' bitmaps put together, word by word.
        word = asked.select("turn", F.posexplode("probes").alias("i", "word")).groupBy("turn", "i").agg(F.bit_or("word").alias("word"))
        bit = word.select("turn", "i", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b")).where("getbit(word, b) = 1")
        open_ = bit.select("turn", (F.col("i") * 64 + F.col("b")).alias("list"))
        units = open_.join(F.broadcast(ends), "list").select("turn", F.explode(F.sequence("first", "last")).alias("shard")).distinct()
        units = cut(units)
        left = shards.join(units, "shard").select("shard", "turn", "vec_id", "list", "vector", "code", "length", "own")
        other = units.select(F.col("turn").alias("turn2"), F.col("shard").alias("shard2"))
        right = asked.withColumnRenamed("turn", "turn2").join(other, "turn2").select("shard2", "turn2", "query_id", "vector", "floor", "probes")
        met = left.groupBy("shard", "turn").cogroup(right.groupBy("shard2", "turn2")).applyInPandas(lambda v, q: search_block(v, q, index, wide, slack), "query_id long, vec_id long, score double")
        if most > 1:
            met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return cut(met.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

    queries = rows.where("q").select("vec_id", "v")
    kind = "query_id long, list int, vector binary, floor double, probes array<long>"
    first = found(queries.mapInArrow(look, kind), slack)
    # Queries with too few rows look once more, into all lists, without floor and bound.
    got_rows = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("got"))
    short = queries.join(got_rows, "vec_id", "left").where(F.coalesce("got", F.lit(0)) < min(k, n_ids - 1)).select("vec_id", "v")
    if short.isEmpty():
        return first
    again = found(short.mapInArrow(look_again, kind), float("inf"))
    return first.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)


def _asked(ids: np.ndarray, near: np.ndarray, vectors: np.ndarray, floor: np.ndarray, lists: np.ndarray) -> pa.RecordBatch:
    words = packed(lists).view("<i8")
    offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * words.shape[1])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(near.astype(np.int32)), pa.array([x.tobytes() for x in vectors], pa.binary()), pa.array(floor), pa.ListArray.from_arrays(offsets, pa.array(words.ravel()))],
        ["query_id", "list", "vector", "floor", "probes"],
    )


def search(table: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", **options) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``."""
    return nearest(table, F.col(vec_id) % every == 0, k, vec_id=vec_id, **options)
