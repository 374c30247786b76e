"""Hard negatives by vantage-point trees over norm-augmented vectors.

Components are scaled and rounded down to whole numbers, so that scores (inner products) are exact. Each vector v gets one part more, the square root of
M - |v|**2 with M the largest squared length; an anchor q gets 0. Then the squared distance of q and v is |q|**2 + M - 2 <q, v>:
larger scores are smaller distances, and a window of scores is an annulus around the anchor.

A tree's node keeps a vantage point and, for each child, the least and largest distance of its rows from that point, so the triangle
inequality bounds the distance of an anchor from all of them, and with it their scores. A traversal takes nodes and rows nearest first
from one heap: a row that comes out is the next best of all, so the first k that fit a window are its result, ties in order of id, and
what cannot reach a window that still lacks rows is never opened.

On Spark the first levels are a tree fitted on a bounded sample (``sample`` rows; a row goes down by its distances, all rows take part), its
leaves are cut to shards of about ``shard`` rows by hash, and each shard grows its own tree in the task that searches it. The bounds of a leaf come
from all its rows. An anchor goes to the shards of those leaves that can hold a result; anchors are dealt in blocks of ``block``, so a
shard's vectors travel once to each block. The k-th best of the sample is a floor that prunes from the start. A first search finds each
anchor's positives, a second one the negatives of all their windows at once. Floors and bounds only leave out what cannot be in the
result: it is exact. In many dimensions bounds are weak, and the work grows with anchors times rows.

Cases: rows without an id, a label or a vector, with a null or non-finite component, or of another dimension than most take no part; a zero
vector does (scores 0); a positive score below 0 has an empty window; rows alike in id, label and vector count once; an anchor's own id is never
its positive; anchors without positives or negatives give no row; scores beyond a long raise; other columns aren't read; an
empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import cut

#: Rows of a tree's leaf.
BUCKET = 64


class Space(NamedTuple):
    """The largest squared length, and what holds components and scores without loss."""

    longest: int
    stored: str
    exact: type

    def scores(self, vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (vectors.astype(self.exact) @ q.astype(self.exact)).astype(np.int64)

    def distances(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Of augmented rows from one of them."""
        own, other = rows.astype(np.float64), point.astype(np.float64)
        up = lambda x: np.sqrt(np.maximum(self.longest - (x**2).sum(axis=-1), 0))
        return np.sqrt(((own - other) ** 2).sum(axis=1) + (up(own) - up(other)) ** 2)

    def apart(self, length: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distances of an anchor of a squared length from rows of some scores."""
        return np.sqrt(np.maximum(length + self.longest - 2.0 * score, 0))


class Bounds(NamedTuple):
    """Least and largest distances as bounds of scores, a little wider than floating point can be wrong."""

    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, total: np.ndarray, near: np.ndarray, far: np.ndarray) -> Bounds:
        slack = 1e-3 + 1e-11 * total
        return cls((total - far**2) / 2 - slack, (total - near**2) / 2 + slack)


def split(space: Space, vectors: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray]:
    """A vantage point among rows, far out (the farthest from the farthest from the first), and the rows' distances from it."""
    point = rows[0]
    for _ in range(2):
        away = space.distances(vectors[rows], vectors[point])
        point = rows[int(away.argmax())]
    return int(point), space.distances(vectors[rows], vectors[point])


class Tree:
    """A vantage-point tree over vectors: inner nodes first to last, children by number, leaves as stretches of ``order``."""

    def __init__(self, space: Space, vectors: np.ndarray, bucket: int = BUCKET):
        self.order, self.points, self.children, self.ranges, self.leaf = np.arange(len(vectors)), [], [], [], []
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            me = len(self.leaf)
            if parent >= 0:
                self.children[parent][side] = me
            self.children.append([-1, -1])
            self.ranges.append([(0.0, 0.0), (0.0, 0.0)])
            self.points.append(-1)
            self.leaf.append((lo, hi))
            if hi - lo <= bucket:
                continue
            rows = self.order[lo:hi]
            point, away = split(space, vectors, rows)
            ranked = np.argsort(away, kind="stable")
            self.order[lo:hi], away = rows[ranked], away[ranked]
            mid = (hi - lo) // 2
            self.points[me] = point
            self.ranges[me] = [(float(away[0]), float(away[mid - 1])), (float(away[mid]), float(away[-1]))]
            todo += [(lo + mid, hi, me, 1), (lo, lo + mid, me, 0)]


class Window_(NamedTuple):
    low: int
    high: int


def nearest_first(space: Space, tree: Tree, vectors: np.ndarray, ids: np.ndarray, fits: np.ndarray, q: np.ndarray, windows: list[Window_], k: int) -> list[list[tuple[int, int]]]:
    """For each window of scores the first k rows (id, score) by score, then id, of those that fit."""
    q = q.astype(np.int64)
    length = float((q.astype(np.float64) ** 2).sum())
    total = length + space.longest
    found: list[list[tuple[int, int]]] = [[] for _ in windows]
    wanted = {i for i, w in enumerate(windows) if w.low <= w.high}
    inner = [i for i, p in enumerate(tree.points) if p >= 0]
    away = dict(zip(inner, space.apart(length, space.scores(vectors[[tree.points[i] for i in inner]], q)).tolist(), strict=True)) if inner else {}
    slack = 1e-3 + 1e-11 * total

    def reaches(low: float, high: float) -> bool:
        return any(windows[i].low <= high and windows[i].high >= low for i in wanted)

    # Entries: minus the largest score, nodes before rows, id, number of the node or score of the row, distances.
    heap: list[tuple] = [(-np.inf, 0, 0, 0, 0.0, np.inf)] if len(ids) else []
    while heap and wanted:
        key, is_row, row_id, n, near, far = heapq.heappop(heap)
        if is_row:
            for i in [i for i in wanted if windows[i].low <= n <= windows[i].high]:
                found[i].append((row_id, n))
                if len(found[i]) == k:
                    wanted.discard(i)
            continue
        if key > -np.inf and not reaches((total - far * far) / 2 - slack, -key):
            continue
        if tree.points[n] < 0:
            rows = tree.order[slice(*tree.leaf[n])]
            rows = rows[fits[rows]]
            score = space.scores(vectors[rows], q)
            ok = np.zeros(len(rows), bool)
            for i in wanted:
                ok |= (score >= windows[i].low) & (score <= windows[i].high)
            for row, s in zip(ids[rows[ok]].tolist(), score[ok].tolist(), strict=True):
                heapq.heappush(heap, (-s, 1, row, s, 0.0, 0.0))
            continue
        d = away[n]
        for child, (a, b) in zip(tree.children[n], tree.ranges[n], strict=True):
            nearer, farther = max(near, d - b, a - d), min(far, d + b)
            high = (total - nearer * nearer) / 2 + slack
            if reaches((total - farther * farther) / 2 - slack, high):
                heapq.heappush(heap, (-high, 0, 0, child, nearer, farther))
    return found


class Top(NamedTuple):
    """The first levels, fitted on a sample: a complete tree of vantage points with radii, node i above 2i + 1 and 2i + 2."""

    space: Space
    points: np.ndarray
    radius: np.ndarray
    depth: int
    ids: np.ndarray
    labels: np.ndarray
    sample: np.ndarray

    @classmethod
    def fit(cls, space: Space, ids: np.ndarray, labels: np.ndarray, sample: np.ndarray, depth: int) -> Top:
        inner = 2**depth - 1
        points, radius = np.zeros((inner, sample.shape[1]), np.int64), np.zeros(inner)
        held = [np.arange(len(sample))] + [None] * (2 * inner)
        for i in range(inner):
            rows = held[i]
            if not len(rows):
                held[2 * i + 1] = held[2 * i + 2] = rows
                continue
            point, away = split(space, sample, rows)
            points[i], radius[i] = sample[point], np.median(away)
            held[2 * i + 1], held[2 * i + 2] = rows[away <= radius[i]], rows[away > radius[i]]
        return cls(space, points, radius, depth, ids, labels, sample)

    def route(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each vector, and its distances from the points on its way."""
        node, away = np.zeros(len(vectors), np.int64), np.zeros((len(vectors), self.depth))
        for level in range(self.depth):
            for i in np.unique(node).tolist():
                of = node == i
                away[of, level] = d = self.space.distances(vectors[of], self.points[i])
                node[of] = np.where(d <= self.radius[i], 2 * i + 1, 2 * i + 2)
        return node - (2**self.depth - 1), away

    def bounds(self, q: np.ndarray, leaves: dict[int, list[tuple[float, float]]]) -> tuple[list[int], Bounds]:
        """Least and largest scores of an anchor with the rows of each leaf."""
        length = float((q.astype(np.float64) ** 2).sum())
        away = self.space.apart(length, self.space.scores(self.points, q)) if len(self.points) else np.empty(0)
        near, far, names = [], [], list(leaves)
        for leaf in names:
            node, path = leaf + 2**self.depth - 1, []
            while node:
                node = (node - 1) // 2
                path.append(away[node])
            sides = list(zip(reversed(path), leaves[leaf], strict=True))
            near.append(max([0.0, *(max(d - b, a - d) for d, (a, b) in sides)]))
            far.append(min([np.sqrt(2.0 * (length + self.space.longest)), *(d + b for d, (a, b) in sides)]))
        total = np.full(len(names), length + self.space.longest)
        return names, Bounds.of(total, np.array(near), np.array(far))


_UNIT = "shard long, part int, anchor_id long, anchor_key long, label long, v binary, lows array<long>, highs array<long>"


def mine(
    table: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 5, percent: tuple[int, int] = (80, 100), scale: int = 256, sample: int = 4096, shard: int = 4096, block: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best rows of the same label
    the best rows of other labels whose score is from percent[0] to percent[1] hundredths of the positive's."""
    spark = table.sparkSession
    x = F.col(vector)
    fine = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    rows = table.where(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole.alias("w"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = rows.withColumns({"d": F.size("w"), "n": F.aggregate("w", F.lit(0).cast("long"), lambda a, c: a + c * c)})
    # A row a dimension that occurs.
    kinds = rows.groupBy("d").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("longest"), F.count_if("asks").alias("asks"), F.max(F.expr("greatest(array_max(w), -array_min(w))")).alias("most"))
    kind = kinds.where("d > 0").orderBy(F.desc("rows"), "d").limit(1).collect()
    if not kind:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    (kind,) = kind
    if kind["longest"] >= 2**62:
        raise ValueError("scores don't fit a long")
    stored = "<i2" if kind["most"] < 2**15 else "<i4" if kind["most"] < 2**31 else "<i8"
    space = Space(kind["longest"], stored, np.float64 if kind["longest"] < 2**52 else np.int64)
    rows = rows.where(F.col("d") == kind["d"]).drop("d", "n")
    some = rows.select("vec_id", "label", "w").orderBy(F.xxhash64("vec_id"), "vec_id", "label", "w").limit(sample).collect()
    depth = min(8, max(0, (kind["rows"] // shard).bit_length()))
    top = Top.fit(space, np.array([r[0] for r in some]), np.array([r[1] for r in some]), np.array([r[2] for r in some], np.int64), depth)
    shared = spark.sparkContext.broadcast(top)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = np.asarray(b.column(2).flatten(), np.int64).reshape(b.num_rows, -1)
            leaf, away = shared.value.route(w)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([v.tobytes() for v in w.astype(stored)], pa.binary()), b.column(3), pa.array(leaf), pa.array(list(away), pa.list_(pa.float64()))],
                ["vec_id", "label", "v", "asks", "leaf", "away"],
            )

    kept = cut(rows.mapInArrow(route, "vec_id long, label long, v binary, asks boolean, leaf long, away array<double>"))
    at = [F.get("away", F.lit(i)) for i in range(depth)]
    # A row a leaf: 256 at most.
    bounds = kept.groupBy("leaf").agg(F.count(F.lit(1)).alias("m"), F.array(*(F.min(c) for c in at)).cast("array<double>").alias("a"), F.array(*(F.max(c) for c in at)).cast("array<double>").alias("b")).collect()
    leaves = {r["leaf"]: list(zip(r["a"], r["b"], strict=True)) for r in bounds}
    starts, n_shards = {}, 0
    for r in sorted(bounds):
        starts[r["leaf"]] = (n_shards, -(-r["m"] // shard))
        n_shards += starts[r["leaf"]][1]
    parts = -(-kind["asks"] // block) or 1
    places = F.broadcast(spark.createDataFrame([(leaf, first, m) for leaf, (first, m) in starts.items()], "leaf long, first long, m long"))
    pieces = kept.join(places, "leaf").select((F.col("first") + F.pmod(F.xxhash64("vec_id", "label", "v"), "m")).alias("shard"), "vec_id", "label", "v")
    dealt = pieces.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    askers = cut(kept.where("asks").select(F.col("vec_id").alias("anchor_id"), F.xxhash64("vec_id", "label", "v").alias("anchor_key"), "label", "v").distinct(), small=True)

    def units(found: DataFrame, same: bool) -> DataFrame:
        """A row for each anchor and shard that can hold a result, with its windows. found: anchors with the scores of their positives."""

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = shared.value
            for b in batches:
                out: list[tuple] = []
                for anchor, key, own, v, scores in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    q = np.frombuffer(v, stored).astype(np.int64)
                    known = top.space.scores(top.sample, q)
                    fits = (top.labels == own) & (top.ids != anchor) if same else top.labels != own
                    known = np.sort(np.unique(np.stack([known[fits], top.ids[fits]]), axis=1)[0])[::-1]
                    windows = [(-(2**63), 2**63 - 1)] if same else [(-(-percent[0] * s // 100), percent[1] * s // 100) for s in scores]
                    k = positives if same else negatives
                    lows, highs = [], []
                    for low, high in windows:  # the k-th best of the sample's rows in the window is a floor
                        inside = known[(known >= low) & (known <= high)]
                        lows.append(max(low, int(inside[k - 1])) if len(inside) >= k else low)
                        highs.append(high)
                    names, bound = top.bounds(q, leaves)
                    for i, leaf in enumerate(names):
                        if any(a <= b and a <= bound.high[i] and b >= bound.low[i] for a, b in zip(lows, highs, strict=True)):
                            first, m = starts[leaf]
                            out += [(first + j, abs(key) % parts, anchor, key, own, v, lows, highs) for j in range(m)]
                    if len(out) >= 10_000:
                        yield _batch(out)
                        out = []
                yield _batch(out)

        return found.select("anchor_id", "anchor_key", "label", "v", "scores").mapInArrow(ask, _UNIT)

    def search(same: bool, k: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            seen, keep = set(), []
            for i, r in enumerate(zip(left["vec_id"].to_pylist(), left["label"].to_pylist(), left["v"].to_pylist(), strict=True)):
                if r not in seen:
                    seen.add(r)
                    keep.append(i)
            out: list[tuple] = []
            if keep and right.num_rows:
                ids, labels = left["vec_id"].to_numpy()[keep], left["label"].to_numpy()[keep]
                vectors = np.stack([np.frombuffer(v.as_py(), stored) for v in left["v"].take(pa.array(keep))])
                tree = Tree(space, vectors)
                for anchor, key, own, v, lows, highs in zip(*(right[c].to_pylist() for c in ("anchor_id", "anchor_key", "label", "v", "lows", "highs")), strict=True):
                    fits = (labels == own) & (ids != anchor) if same else labels != own
                    got = nearest_first(space, tree, vectors, ids, fits, np.frombuffer(v, stored), list(map(Window_, lows, highs)), k)
                    out += [(anchor, key, i, row, s) for i, found in enumerate(got) for row, s in found]
            return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["anchor_id", "anchor_key", "window", "vec_id", "score"])

        return run

    def best(found: DataFrame, same: bool, k: int) -> DataFrame:
        met = dealt.groupBy("shard", "part").cogroup(units(found, same).groupBy("shard", "part")).applyInArrow(search(same, k), "anchor_id long, anchor_key long, window int, vec_id long, score long")
        order = F.row_number().over(W.partitionBy("anchor_id", "anchor_key", "window").orderBy(F.desc("score"), "vec_id"))
        return met.withColumn("rank", order).where(F.col("rank") <= k)

    own = cut(best(askers.withColumn("scores", F.array().cast("array<long>")), True, positives), small=True)
    near = own.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))  # ``positives`` at most
    found = cut(askers.join(near, ["anchor_id", "anchor_key"]).withColumn("scores", F.col("near.score")), small=True)
    got = best(found, False, negatives).join(found.select("anchor_id", "anchor_key", "near"), ["anchor_id", "anchor_key"])
    positive = F.get("near", F.col("window"))
    return got.select("anchor_id", positive["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ["shard", "part", "anchor_id", "anchor_key", "label", "v", "lows", "highs"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def relabelled(table: DataFrame, classes: int = 10) -> DataFrame:
    """The table, where the label of ids divisible by 7 is the next one, as the query's contract has it."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    return table.select("vec_id", "embedding", moved.alias("label"))
