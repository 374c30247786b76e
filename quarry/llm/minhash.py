"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch.  A set of hashed shingles fills t bins in rounds. In each of the first t rounds every element is thrown to a random bin
with a random value; round t + i throws all elements to bin i, so no bin can stay empty. A bin keeps the value of the earliest
round that reached it, the smallest within that round; rounds end when all bins are full, after about t log(t) / n of them for n
elements. Each bin agrees between two sets with probability equal to their Jaccard similarity, with concentration as strong as for
t independent hashes.

Candidates.  Bands of 4 bins: with 32 bands a pair at similarity 0.8 is missed with probability 5e-8, at 0.85 with 6e-11.

Links.  Texts with the same shingle set are one class; only one member of a class goes on. Members of buckets are first compared with
one leader each, and linked members form components. Buckets that then still hold several components are searched for the links
between them without forming their pairs: members are described by how they differ from the group's majority, and a link needs common
differences (see _cross_links). So no link of a bucket is lost, and groups of thousands of near copies cost no squares. Links are
confirmed on the full sets.

Cases: a text without words (null, empty, blank) has no shingles and stands alone; texts shorter than a shingle are one shingle, of
the whole sequence; rows without an id stand alone and are kept; repeated ids are one document, linked by any of its texts; ids that
aren't numbers are null by the cast to long (an error under ANSI rules); an empty
table gives an empty table; columns other than the id and the text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WordHashes, cut, drop, held, mix64, rolling, small_batches, tidy

BINS, BAND = 128, 4
_ROUND = np.arange(2 * BINS, dtype=np.uint64)
_SEEDS = mix64(_ROUND + np.uint64(0x5851F42D4C957F2D))


def shingle_hashes(text: str | None, cache: WordHashes, k: int = 5) -> np.ndarray:
    """The distinct hashed shingles of a text, sorted. bytes.lower() touches A-Z alone, bytes.split() cuts at ASCII white space."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    hashes = cache.of(found)
    if len(found) < k:
        return rolling(hashes, len(found)) ^ np.uint64(0xA5A5A5A5 + len(found))
    return np.unique(rolling(hashes, k))


def sketch(elements: np.ndarray) -> np.ndarray:
    """The BINS values of a non-empty set."""
    n = len(elements)
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < 2 * BINS:
        upto = min(at + max(1, 4096 // n), BINS if at < BINS else 2 * BINS)
        x = mix64(elements[None, :] ^ _SEEDS[at:upto, None])
        value = (x >> np.uint64(16)) | (_ROUND[at:upto, None] << np.uint64(48))
        if at < BINS:
            np.minimum.at(out, (x % np.uint64(BINS)).astype(np.intp).ravel(), value.ravel())
        else:
            np.minimum(out[at - BINS : upto - BINS], value.min(axis=1), out=out[at - BINS : upto - BINS])
        at = upto
        if out.max() < np.iinfo(np.uint64).max:
            break
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """A hash for each band of the sketch; the band's number is part of it."""
    parts = values.reshape(-1, BAND)
    out = np.arange(len(parts), dtype=np.uint64)
    for i in range(BAND):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return out


def sketches(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_hash (16 bytes), bands array<long>; docs has doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held("minhash")
        tidy()
        cache = WordHashes()
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                sizes, digests, found = [], [], []
                for text in b.column(1):
                    s = shingle_hashes(text.as_py(), cache, k)
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    found.append(bands(sketch(s)).view(np.int64) if len(s) else np.empty(0, np.int64))
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "n_shingles", "set_hash", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def shingle_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, shingles array<long> (distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("minhash")
        tidy()
        cache = WordHashes()
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                found = [shingle_hashes(x.as_py(), cache, k).view(np.int64) for x in b.column(1)]
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node that it reaches), for the nodes of edges (a, b): smallest neighbour's label, then a jump to
    the label's own label, until nothing changes. The number of rounds is logarithmic for the stars that leaders make."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), light=True)
    held = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), light=True)
    labels = held
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("new"))
        own = labels.select(F.col("node").alias("new"), F.col("comp").alias("jump"))
        stepped = cut(lower.join(own, "new", "left").select("node", "old", F.least("new", F.coalesce("jump", "new")).alias("comp")), light=True)
        drop(held)
        held, labels = stepped, stepped.select("node", "comp")
        if stepped.where("comp <> old").isEmpty():
            drop(both)
            return labels


#: Ids that a broadcast may hold (8 bytes each); with more, texts and ids are shuffled to meet.
MOST_BROADCAST = 2_000_000


def _sets(need: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """node, shingles for the documents of need (node). Texts are read again for these alone."""
    need = cut(need.select(F.col("node").alias("doc_id")).distinct(), light=True)
    small = need.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    chosen = docs.join(F.broadcast(need) if small else need, "doc_id", "left_semi")
    return shingle_sets(chosen, k).withColumnRenamed("doc_id", "node")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    sets = cut(_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, k))
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    found = cut(pairs.join(right, "b").join(left, "a").where(100 * common >= percent * union).select("a", "b").distinct(), light=True)
    drop(sets)
    return found


def _xor(a: str, b: str) -> Column:
    """The symmetric difference of two arrays of distinct values."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


#: Members of a group that one task compares with the group's sets.
PART = 2_000


def _cross_links(groups: DataFrame, comps: DataFrame, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that are sure, and candidate pairs (a, b), within groups (lead, node), without forming a group's pairs.

    For any set P, the symmetric difference of x and y is that of D(x) = x ^ P and D(y) = y ^ P. With c = (1 - t) / (1 + t) and
    f(x) = c |x| - |D(x)|, x and y are linked if and only if f(x) + f(y) + 2 |D(x) & D(y)| >= 0. P is the group's majority set, which
    makes differences short and their elements rare. Then
    - x and y with f(x) + f(y) >= 0 are linked, and both to the member m with the largest f: a star around m makes all these links;
    - other links need o = -(f(x) + f(y)) / 2 > 0 common elements of D. One end at least isn't in the star (an outlier: two members
      of the star are connected anyway). In order of rarity two sets with o common elements share one of the first |D| - o + 1, and
      from the first that they share on, both still have o elements. Elements whose members are all of one component can't make a
      new link.

    A large group's members are dealt to parts, each of which gets the group's two sets; what is left of a group is one row a member
    with short differences."""
    c = (100 - percent) / (100 + percent)
    turns = F.ceil(F.col("g") / PART).cast("int")
    sizes = cut(groups.groupBy("lead").agg(F.count(F.lit(1)).alias("g")), light=True)
    split = sizes.select("lead", "g", turns.alias("turns"))
    each = lambda df: df.join(split, "lead").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    dealt = groups.join(split, "lead").withColumn("part", F.pmod(F.xxhash64("node"), F.col("turns")).cast("int"))
    sets = cut(_sets(groups.select(F.explode(F.array("lead", "node")).alias("node")), docs, k))
    base = each(sets.select(F.col("node").alias("lead"), F.col("shingles").alias("base"))).select("lead", "part", "base")
    # Partly aggregated before the shuffle by (lead, e), so that an element of all members is a row a task.
    diffs = cut(dealt.select("lead", "part", "node").join(sets, "node").join(base, ["lead", "part"]).select("lead", "part", "node", F.size("shingles").alias("n"), _xor("shingles", "base").alias("d")))
    drop(sets)
    common = diffs.select("lead", F.explode("d").alias("e")).groupBy("lead", "e").agg(F.count(F.lit(1)).alias("c"))
    # A majority set is no longer than twice the mean difference.
    major = each(common.join(split.select("lead", "g"), "lead").where("2 * c > g").groupBy("lead").agg(F.collect_list("e").alias("m"))).select("lead", "part", "m")
    moved = diffs.join(major, ["lead", "part"], "left").withColumn("m", F.coalesce("m", F.array().cast("array<bigint>")))
    moved = moved.select("lead", "part", "node", "n", _xor("d", "m").alias("d")).withColumn("f", c * F.col("n") - F.size("d"))
    moved = cut(moved.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), small=True)
    drop(diffs)
    top = moved.groupBy("lead").agg(F.max(F.struct("f", "node")).alias("top")).select("lead", F.col("top.f").alias("most"), F.col("top.node").alias("star"))
    rated = moved.join(each(top).select("lead", "part", "most", "star"), ["lead", "part"]).withColumn("out", F.col("f") + F.col("most") < -1e-6)
    stars = cut(rated.where(~F.col("out") & (F.col("node") != F.col("star"))).select(F.col("star").alias("a"), F.col("node").alias("b")).distinct(), light=True)
    outer = rated.where("out").groupBy("lead").agg(F.max("f").alias("most_out"))
    open_ = rated.join(each(outer).select("lead", "part", "most_out"), ["lead", "part"])
    # An outlier's partner may be any member; another member's partner, as far as it matters, is an outlier.
    least = F.greatest(F.lit(1), F.ceil(-(F.col("f") + F.when(F.col("out"), F.col("most")).otherwise(F.col("most_out"))) / 2 - 1e-6))
    member = ["lead", "node", "n", "f", "comp", "out", "keep", "all"]
    prefix = open_.withColumns({"keep": (F.size("d") - least + 1).cast("int"), "all": F.size("d")}).where("keep > 0").select(*member, F.explode("d").alias("e"))
    rare = prefix.groupBy("lead", "e").agg(F.count(F.lit(1)).alias("c"), F.max("out").alias("any"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    # Elements of one member only can't be shared; they come first in the order, so only their number matters. Those of one component
    # alone are shared, but make no new link: they keep their place, and are left out after the prefix is taken.
    rare = rare.where("c > 1").select("lead", "e", "c", (F.col("any") & (F.col("lo") != F.col("hi"))).alias("use"))
    shared = prefix.join(rare, ["lead", "e"]).groupBy(*member).agg(F.sort_array(F.collect_list(F.struct("c", "e", "use"))).alias("es"))
    first = F.slice("es", 1, F.greatest(F.lit(0), F.col("keep") - (F.col("all") - F.size("es"))).cast("int"))
    # rest: how many elements come after one in the order. Two sets whose first common element this is share at most 1 + rest.
    placed = shared.select("lead", "node", "n", "f", "comp", "out", F.size("es").alias("left"), F.posexplode(first).alias("i", "x")).where("x.use")
    tokens = cut(placed.select("lead", "node", "n", "f", "comp", "out", F.col("x.e").alias("e"), (F.col("left") - 1 - F.col("i")).alias("rest")))
    drop(moved, sizes)
    x = tokens.where("out").select("lead", "e", F.col("node").alias("a"), F.col("n").alias("na"), F.col("f").alias("fa"), F.col("comp").alias("ca"), F.col("rest").alias("ra"))
    y = tokens.select(F.col("lead").alias("lead2"), F.col("e").alias("e2"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("f").alias("fb"), F.col("comp").alias("cb"), F.col("rest").alias("rb"), F.col("out").alias("yout"))
    alike = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    enough = 1 + F.least("ra", "rb") >= -(F.col("fa") + F.col("fb")) / 2 - 1e-6
    met = x.join(y, (F.col("lead") == F.col("lead2")) & (F.col("e") == F.col("e2")) & (F.col("ca") != F.col("cb")) & (~F.col("yout") | (F.col("a") < F.col("b"))) & alike & enough)
    pairs = cut(met.select("a", "b").distinct(), small=True)
    drop(tokens)
    return stars, pairs


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each input row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    sketched = cut(sketches(docs, k))
    base = cut(sketched.drop("bands"))
    real = sketched.where("n_shingles > 0 and doc_id is not null")
    # Rows of one id with several texts count as linked; a class of equal sets is its smallest id.
    classes = cut(real.groupBy("set_hash", "n_shingles").agg(F.min("doc_id").alias("rep")), small=True)
    own = real.join(classes.select("rep", F.col("set_hash").alias("h")), (F.col("doc_id") == F.col("rep")) & (F.col("set_hash") == F.col("h")))
    exploded = own.select(F.col("rep").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("band")
    members = cut(exploded.join(shared, "band"), small=True)
    texts = docs.where("doc_id is not null")
    repeated = real.groupBy("doc_id").agg(F.min("set_hash").alias("x"), F.max("set_hash").alias("y")).where("x <> y").select("doc_id")
    edges = cut(real.join(repeated, "doc_id", "left_semi").join(classes, ["set_hash", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b"), light=True)
    drop(sketched)
    comps = components(edges)
    lead = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node"), F.col("n"))).alias("lead")
    alike = 100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")
    met = members.join(members.groupBy("band").agg(lead), "band").where("node <> lead.node")
    # Each member is compared with one leader, the first by hash among those of its buckets.
    pairs = cut(met.where(alike).groupBy(F.col("node").alias("b")).agg(F.min("lead").alias("lead")).select(F.col("lead.node").alias("a"), "b"), light=True)
    if not pairs.isEmpty():
        more = _verified(pairs, texts, k, percent)
        edges, comps = _with(edges, more, comps)
    drop(pairs)
    now = members.join(comps, "node", "left").select("band", "node", "n", F.coalesce("comp", "node").alias("comp"))
    open_ = now.groupBy("band").agg(lead, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    groups = cut(now.join(open_.select("band", F.col("lead.node").alias("lead")), "band").select("lead", "node").distinct(), small=True)
    drop(members)
    if not groups.isEmpty():
        stars, rest = _cross_links(groups, comps, texts, k, percent)
        drop(groups)
        edges, comps = _with(edges, stars, comps)
        if not rest.isEmpty():
            edges, comps = _with(edges, _verified(rest, texts, k, percent), comps)
        drop(rest)
    drop(edges)
    placed = base.join(classes, ["set_hash", "n_shingles"], "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("comp", "rep"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _with(edges: DataFrame, more: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges with more, and their components, in place of those before."""
    every = cut(edges.union(more), light=True)
    drop(edges, more)
    return every, components(every)
