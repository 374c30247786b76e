"""Exact order statistics of any number of values: the interval that holds a rank is cut to bins, counted, and narrowed to the bin that
holds it, until that bin is one value. A pass counts ``BINS`` bins for each rank; no task sorts more than it reads, and the driver gets counts alone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import checkpointed, discard

BINS = 512


def at_shares(df: DataFrame, value: str, shares: tuple[float, ...]) -> tuple[int, list[float | None]]:
    """How many values there are (nulls and NaN aren't), and for each share s the element at floor(n * s) of the ascending order (the last one
    at most; None of no values)."""
    v = F.col(value).cast("double")
    rows = checkpointed(df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v)))
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return 0, [None] * len(shares)
    found: dict[int, float] = {}
    left = {k: (lo, hi, min(n - 1, math.floor(n * s))) for k, s in enumerate(shares)}
    while True:
        for k, (a, b, _) in list(left.items()):
            if a == b:
                found[k] = a
                del left[k]
        if not left:
            discard(rows)
            return n, [found[k] for k in range(len(shares))]
        # Intervals start and end at values, and two of them are equal or apart, so a value is in one at most.
        spans = sorted({(a, b) for a, b, _ in left.values()})
        span, place = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (a, b) in enumerate(spans):
            inside = F.col("v").between(a, b)
            # Halves keep the difference of very large values finite.
            bin_ = F.least(F.floor((F.col("v") / 2 - a / 2) / (b / 2 - a / 2) * BINS), F.lit(BINS - 1)).cast("int")
            span, place = F.when(inside, i).otherwise(span), F.when(inside, bin_).otherwise(place)
        counts = rows.select(span.alias("span"), place.alias("bin"), "v").where("span is not null").groupBy("span", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        bins: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r["span"], r["bin"])):
            bins.setdefault(r["span"], []).append(r)
        for k, (a, b, rank) in list(left.items()):
            for r in bins[spans.index((a, b))]:
                if rank < r["n"]:
                    left[k] = (r["a"], r["b"], rank)
                    break
                rank -= r["n"]
