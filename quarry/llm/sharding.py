"""Sharding by a Feistel permutation over global row numbers. DataFrame functions only.

Every row gets a global number: rows are dealt by a hash to a fixed number of buckets, numbered within their bucket by
(doc_id, checksum, size), and shifted by the sizes of the buckets before. That order depends on the rows alone, so a lost task
gives the same numbers again. A permutation of 0..N-1 then shuffles the numbers: a Feistel network over pairs (left, right) with
left < a, right < b, a * b >= N, whose results beyond N-1 are permuted again until they fall inside (cycle walking). Shard and slot
are remainder and quotient of the permuted number, so counts differ by one at most and slots have no gaps (law ``rows``).

Cases: a null text has no bytes (size 8, checksum 0); null ids are numbered first in their bucket; repeated rows are each placed,
and equal ones may swap places, which shows in no column; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: More steps than a walk can need: of N <= 4096 at most 64 lie beyond; for larger N each step leaves the range with
#: probability under 1/64, so that 64 in a row have one under 2**-384. A walk that still isn't done raises.
STEPS = 64


def _network(x: Column, a: Column, b: Column, keys: list[int]) -> Column:
    """One pass of the network: each round adds a keyed hash of one half to the other."""

    def round_(s: Column, k: Column) -> Column:
        left = F.pmod(s.l + F.pmod(F.xxhash64(k, s.r), a), a)
        return F.struct(left.alias("l"), F.pmod(s.r + F.pmod(F.xxhash64(k, left), b), b).alias("r"))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.array(*[F.lit(k).cast("long") for k in keys]), start, round_, lambda s: s.l * b + s.r)


def permute(x: Column, n: Column, a: Column, b: Column, seed: int = 1, rounds: int = 4) -> Column:
    """The place of number x in a pseudo-random permutation of 0..n-1."""
    keys = [seed * 1_000_003 + i for i in range(rounds)]
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), _network(x, a, b, keys), lambda y, _: F.when(y < n, y).otherwise(_network(y, a, b, keys)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a cycle walk didn't end")).cast("long"))


def shard(docs: DataFrame, shards: int = 24, seed: int = 1, buckets: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and row_number (before the shuffle)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    # One row a bucket, of which there are at most ``buckets``: the only rows that one task holds, and the ones broadcast.
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(W.partitionBy()).alias("total"))
    sizes = sizes.withColumn("a", F.greatest(F.lit(1), F.ceil(F.sqrt("total"))).cast("long"))
    sizes = sizes.withColumn("b", F.greatest(F.lit(1), F.ceil(F.col("total") / F.col("a"))).cast("long"))
    own = F.row_number().over(W.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size")).cast("long") - 1
    numbered = rows.withColumn("own", own).join(F.broadcast(sizes), "bucket").withColumn("row_number", F.col("start") + F.col("own"))
    placed = numbered.withColumn("place", permute(F.col("row_number"), F.col("total"), F.col("a"), F.col("b"), seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("place"), F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def place(row_number: int, n: int, shards: int = 24, seed: int = 1, rounds: int = 4) -> tuple[int, int]:
    """Shard and slot of a global row number, computed without any data."""
    import math
    import struct

    import xxhash

    def keyed(key: int, value: int) -> int:
        out = 42
        for v in (key, value):
            out = xxhash.xxh64_intdigest(struct.pack("<q", v), out)
        return out - (1 << 64) if out >= 1 << 63 else out

    a = max(1, math.ceil(math.sqrt(n)))
    b = max(1, math.ceil(n / a))
    x = row_number
    while True:
        left, right = divmod(x, b)
        for i in range(rounds):
            left = (left + keyed(seed * 1_000_003 + i, right) % a) % a
            right = (right + keyed(seed * 1_000_003 + i, left) % b) % b
        x = left * b + right
        if x < n:
            return x % shards, x // shards
