"""Similar names and sets, blocked so that no operator compares all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import round_half_up
from quarry.operators.graph import checkpointed


def similar_names(names: DataFrame, share: float) -> DataFrame:
    """a, b, distance for names(id, name, block) of one block whose edit distance is within ``share`` of the longer name.

    Blocks are split by length first: names whose lengths differ by more than the distance allows never meet."""
    n = F.length("name")
    reach = F.floor(n * share / (1 - share)).cast("int")
    left = names.select("id", "name", "block", F.explode(F.sequence(n, n + reach)).alias("len"))
    right = names.select(F.col("id").alias("id2"), F.col("name").alias("name2"), F.col("block").alias("block2"), n.alias("len2"))
    most = F.floor(F.greatest(F.length("name"), F.length("name2")) * share).cast("int")
    met = left.join(right, (F.col("block") == F.col("block2")) & (F.col("len") == F.col("len2")) & (F.col("id") != F.col("id2")) & ((n < F.col("len2")) | (F.col("id") < F.col("id2"))))
    scored = met.withColumn("distance", F.levenshtein("name", "name2")).where(F.col("distance") <= most)
    return scored.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), F.col("distance").cast("int").alias("distance"))


def jaccard_pairs(sets: DataFrame, above: float, few: int = 16) -> DataFrame:
    """a, b, similarity for sets(id, s) whose Jaccard similarity exceeds ``above``: sets meet by two of their first elements.

    All sets have their elements in one order, those last that make up more than a thousandth of all (at most 1,000). A set of n that is
    like others shares at least ``least`` elements with each, so the first l of those are among its first n - least + l. Sets of at most
    ``few`` elements meet by each two of these, as hardly any sets that are not alike share two; larger ones, and those that one common
    element is enough for, by single ones. What meets is compared in full."""
    sets = checkpointed(sets.select("id", "s"))
    rows = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    often = sets.select(F.explode("s").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > rows / 1000).orderBy("c", "x").collect()
    last = F.array(*[F.lit(r.x) for r in often]).cast(sets.schema["s"].dataType)
    o = F.transform(F.array_sort(F.transform("s", lambda x: F.struct(F.array_position(last, x).alias("h"), x.alias("x")))), lambda t: t["x"]) if often else F.array_sort("s")
    n = F.size("s")
    fewest = F.floor(above * n - 1e-9) + 1
    least = F.floor(above * (n + fewest) / (1 + above) - 1e-9) + 1
    first = lambda k: F.slice("o", 1, F.least("n", F.col("n") - F.col("least") + k).cast("int"))
    one = F.transform(first(1), lambda x: F.xxhash64(x))
    two = F.transform(first(2), lambda x, i: F.transform(F.slice(first(2), i + 2, F.col("n")), lambda y: F.xxhash64(x, y)))
    none = F.array().cast("array<bigint>")
    keys = F.concat(F.when((F.col("least") <= 1) | (F.col("n") > above * few), one).otherwise(none), F.when(F.col("n") <= few, F.flatten(two)).otherwise(none))
    index = sets.where("size(s) > 0").select("id", n.alias("n"), least.alias("least"), o.alias("o")).select("id", "n", F.explode(keys).alias("key"))
    # Most keys have one set alone: they leave before ids meet.
    index = checkpointed(index.withColumn("c", F.count(F.lit(1)).over(W.partitionBy("key"))).where("c > 1").drop("c"))
    other = index.select(F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("key").alias("key2"))
    fits = F.least("n", "n2") > above * F.greatest("n", "n2")
    pairs = checkpointed(index.join(other, (F.col("key") == F.col("key2")) & (F.col("id") < F.col("id2")) & fits).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct())
    met = pairs.join(sets.select(F.col("id").alias("a"), "s"), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("s2")), "b")
    common = F.size(F.array_intersect("s", "s2"))
    union = F.size("s") + F.size("s2") - common
    return met.where(common > above * union).select("a", "b", round_half_up(common / union, 3).alias("similarity"))
