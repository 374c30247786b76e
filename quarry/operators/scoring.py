"""Scores: weights, multipliers, relative normalisation and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import round_half_up
from quarry.operators.selection import at_shares

#: Weights of the sub-scores (fixed values); they are scaled to a sum of 1 where used.
WEIGHTS = {
    "cyclomatic": 0.12, "cognitive": 0.10, "coupling": 0.12, "maintainability": 0.10, "react": 0.08, "container": 0.08,
    "error_handling": 0.12, "types": 0.08, "flow": 0.08, "zombie": 0.04, "circular": 0.03, "translation": 0.04, "seo": 0.03,
    "accessibility": 0.03, "performance": 0.02, "duplication": 0.02, "code_metrics": 0.01, "magic_numbers": 0.01,
}
#: Lower bounds of the score ranges (fixed values).
RANGES = (("critical", 80), ("high", 60), ("medium", 40), ("low", 20), ("minimal", 0))


def weighted(scores: dict[str, Column], weights: dict[str, float] | None = None, excluded: tuple[str, ...] = ()) -> Column:
    """The weighted mean of sub-scores, over those that aren't excluded."""
    used = {k: w for k, w in (weights or WEIGHTS).items() if k in scores and k not in excluded}
    total = sum(used.values())
    return sum((scores[k] * (w / total) for k, w in used.items()), F.lit(0.0))


def multiplied(score: Column, factors: list[tuple[Column, float]]) -> Column:
    """Each factor applies where its condition holds; the result stays within 100."""
    for condition, factor in factors:
        score = score * F.when(condition, factor).otherwise(1.0)
    return round_half_up(F.least(F.lit(100.0), score), 2)


def range_of(score: Column) -> Column:
    out = F
    for name, least in RANGES:
        out = out.when(score >= least, name)
    return out.otherwise("minimal")


def quartiles(df: DataFrame, value: str) -> DataFrame:
    """One row: n, lo, hi, q1, q3, the quartiles being the elements at floor(n/4) and floor(3n/4) of the ascending order, selected without a sort."""
    n, found = at_shares(df, value, (0.0, 0.25, 0.75, 1.0))
    return df.sparkSession.createDataFrame([(n, found[0], found[3], found[1], found[2])], "n long, lo double, hi double, q1 double, q3 double")


def normalised(df: DataFrame, value: str) -> DataFrame:
    """All columns and ``normalised``: seven parts min-max, three parts position between the quartiles, the upper half compressed by a logarithm."""
    v, lo, hi, q1, q3 = (F.col(x) for x in (value, "_lo", "_hi", "_q1", "_q3"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    place = F.when(v <= q1, part(v, q1) * 25).when(v <= q3, 25 + part(v - q1, q3 - q1) * 50).otherwise(75 + part(v - q3, hi - q3) * 25)
    mixed = part(v - lo, hi - lo) * 100 * 0.7 + place * 0.3
    upper = F.least(F.lit(100.0), 50 + (mixed - 50) * F.log10(mixed - 49) / F.log10(F.lit(51.0)))
    score = F.when(hi - lo > 0, F.when(mixed > 50, upper).otherwise(mixed)).otherwise(50.0)
    stats = quartiles(df, value).select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("q1").alias("_q1"), F.col("q3").alias("_q3"))
    # One row of statistics for all.
    return df.join(F.broadcast(stats)).withColumn("normalised", round_half_up(score, 2)).drop("_lo", "_hi", "_q1", "_q3")


def component_complexity(imports: Column, used_by: Column, exports: Column, functions: Column, calls: Column, required: Column, optional: Column) -> Column:
    base = imports + used_by + 0.5 * exports + 1.5 * functions + 0.3 * calls + 1.2 * required + 0.8 * optional
    return round_half_up(base * F.when(used_by > 5, 1 + 0.1 * (used_by - 5)).otherwise(1.0), 1)


def coupling_degree(di: Column, ci: Column, do: Column, co: Column, gd: Column, gc: Column, w: Column, r: Column) -> Column:
    """1 less the reciprocal of the weighted connections; 0 where there are none."""
    total = di + 2 * ci + do + 2 * co + gd + 2 * gc + w + r
    return F.when(total > 0, round_half_up(1 - F.lit(1.0) / total, 2)).otherwise(0.0)


def maintainability(volume: Column, cyclomatic: Column, lines: Column, repetition: Column, functions: Column, connections: Column) -> Column:
    """0 to 100: the index of Halstead volume, cyclomatic complexity and lines, less penalties."""
    one = F.lit(1.0)
    raw = (171 - 5.2 * F.log(F.greatest(volume, one)) - 0.23 * cyclomatic - 16.2 * F.log(F.greatest(lines, one))) * 100 / 171
    less = F.least(repetition, F.lit(15.0)) + F.least(F.greatest(functions - 20, F.lit(0)), F.lit(10)) + F.least(F.greatest(connections - 15, F.lit(0)), F.lit(8))
    return round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw) - less)), 2)


def halstead_volume(total: Column, distinct: Column) -> Column:
    return F.when(distinct > 0, total * F.log2(distinct.cast("double"))).otherwise(0.0)
