"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Targets.  Sources in order of code point (null last) weigh 5, 2, 1, repeating; they share a given multiple of all words by weight, a
source's target stops at a multiple of its own words, and the excess is shared again among the rest by weight until none is above.

Rates.  Among all document rates that give a source its target, entropy balancing takes those nearest to 1 in relative entropy,
none above the limit: rate = min(limit, exp(lambda * size / scale)), with one lambda a source. lambda solves the dual, a convex
problem in one variable, by Newton steps kept inside a bracket; each step is one distributed sum over the counts of (source, size).

Copies.  A rate is rounded to copies by a hash of the document (its expectation is the rate). What a source is then short of or over
its target, in words, is made up in hash order: documents gain or lose one copy until the sum fits, the last of them in part. Prefix
sums go over buckets of documents, so no source is summed by one task.

Cases: a null or blank text has size 0 and is taken 0 times; a null source is a source of its own, the last; sources without words
have target 0; rows with null or repeated ids are mixed like others (equal rows may swap their parts); an empty table gives an empty
table; columns other than id, text and source aren't read.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import WORD, cut

#: Sources that a broadcast may hold, a few dozen bytes each.
MOST_BROADCAST = 100_000


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), limit: float = 2.0) -> DataFrame:
    """source, sid, source_size, target from (source, source_size): water-filling over one row a source."""
    everything = W.partitionBy()
    t = sizes.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    t = t.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("most", limit * F.col("source_size")).withColumn("level", F.col("most") / F.col("w"))
    # In order of the level at which a source is full, the full ones come first; the first that is not full sets the level of all.
    ahead = W.orderBy("level", "sid").rowsBetween(W.unboundedPreceding, -1)
    rest = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(ahead), F.lit(0.0))
    t = t.withColumn("at", rest / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(ahead), F.lit(0.0))))
    t = t.withColumn("fill", F.min(F.when(F.col("at") < F.col("level"), F.struct("level", "sid", "at"))).over(everything)["at"])
    return t.select("source", "sid", F.col("source_size").cast("long").alias("source_size"), F.least(F.col("most"), F.coalesce(F.col("fill") * F.col("w"), F.col("most"))).alias("target"))


def solve(counts: DataFrame, targets: DataFrame, limit: float = 2.0, steps: int = 40, close: float = 1e-6) -> DataFrame:
    """sid, lambda, scale, full: counts has (sid, size, n), targets has (sid, source_size, target)."""
    scale = counts.groupBy("sid").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))).alias("scale"))
    full = F.col("target") >= limit * F.col("source_size") * (1 - 1e-12)
    start = F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.greatest(F.col("source_size"), F.lit(1)))
    state = cut(
        targets.join(scale, "sid")
        .select("sid", "target", "scale", full.alias("full"), start.alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(False).alias("done"))
        .withColumn("done", F.col("full") | (F.col("target") <= 0)),
        light=True,
    )
    for _ in range(steps):
        if state.where("not done").isEmpty():
            break
        x = F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(limit)), F.exp(F.least(F.col("lam") * x, F.lit(50.0))))
        words = F.col("n") * F.col("size")
        sums = (
            counts.join(state.where("not done").select("sid", "lam", "scale"), "sid")
            .groupBy("sid")
            .agg(F.sum(words * rate).alias("value"), F.sum(F.when(rate < limit, words * rate * x).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("value") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        nxt = F.when((newton > F.col("lo2")) & (newton < F.col("hi2")), newton).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        moved = state.join(sums, "sid", "left").withColumn("lo2", F.when(F.col("done"), F.col("lo")).otherwise(lo)).withColumn("hi2", F.when(F.col("done"), F.col("hi")).otherwise(hi))
        ended = F.col("done") | (F.abs(gap) <= close * F.col("target"))
        state = cut(moved.select("sid", "target", "scale", "full", F.when(ended, F.col("lam")).otherwise(nxt).alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), ended.alias("done")), light=True)
    open_ = state.where("not done").count()
    if open_:
        warnings.warn(f"the rates of {open_} sources are {steps} steps from the start and not within {close} of their target; copies make up the rest", stacklevel=2)
    return state.select("sid", F.col("lam").alias("lambda"), "scale", "full")


def _uniform(*columns: Column | str) -> Column:
    """A number from 0 up to but not including 1, by hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 50)) / float(1 << 50)


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), limit: float = 2.0, buckets: int = 1024, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, print (a hash of the text), source, size, source_size, target, rate, taken: a row for each input row."""
    body = F.col(text).cast("string")
    rows = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(body).alias("print"),
        )
    )
    counts = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts, light=True)
    sizes = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = cut(source_targets(sizes, share, weights, limit), light=True)
    named = targets.select(F.col("source").alias("s2"), "sid", "source_size", "target")
    by_sid = cut(counts.join(named, counts["source"].eqNullSafe(named["s2"])).select("sid", "size", "n"), light=True)
    solved = solve(by_sid, targets, limit)
    plan = cut(targets.join(solved, "sid"), light=True)  # one row a source
    # One row a source: few enough to broadcast unless counted otherwise, so that a large source isn't dealt to one task.
    near = F.broadcast if targets.count() <= MOST_BROADCAST else (lambda df: df)
    plan = near(plan.withColumnRenamed("source", "s2"))
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("full"), F.lit(float(limit))).otherwise(
        F.when(F.col("target") > 0, F.least(F.lit(float(limit)), F.exp(F.least(F.col("lambda") * F.col("size") / F.col("scale"), F.lit(50.0))))).otherwise(0.0)
    )
    whole = F.least(F.lit(int(limit)), F.floor(F.col("rate") + _uniform(F.lit("copies"), "doc_id", "print")))
    rated = rows.join(plan, rows["source"].eqNullSafe(plan["s2"])).withColumn("rate", rate)
    first = rated.withColumn("copies", whole.cast("long")).withColumn("bucket", F.pmod(F.xxhash64(F.lit("order"), "doc_id", "print"), F.lit(buckets)).cast("int"))
    first = cut(first.select("doc_id", "print", "source", "sid", "size", "source_size", "target", "rate", "copies", "bucket"))
    short = first.groupBy("sid").agg((F.floor(F.max("target") + 0.5).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
    # At most ``buckets`` rows a source.
    room = F.when(F.col("short") > 0, F.least(F.col("size"), int(limit) * F.col("size") - F.col("copies") * F.col("size"))).otherwise(F.least(F.col("size"), F.col("copies") * F.col("size")))
    open_ = first.join(near(short), "sid").withColumn("room", room)
    per = open_.groupBy("sid", "bucket").agg(F.sum("room").alias("n"))
    ahead = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = per.select("sid", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inside = W.partitionBy("sid", "bucket").orderBy("doc_id", "print", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("room").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("room"), F.abs("short") - before))
    taken = F.col("copies") * F.col("size") + F.signum(F.col("short").cast("double")).cast("long") * part
    return open_.join(starts, ["sid", "bucket"]).withColumn("taken", taken).select("doc_id", "print", "source", "size", "source_size", "target", "rate", "taken")


def materialize(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mixed documents: each row as often as it is taken, the one partly taken copy a source cut after a word. Columns of docs.

    Rows that are equal in id, text and source are one row here, taken as often as all of them are."""
    plan = mix(docs, text=text, source=source, doc_id=doc_id, **options)
    plan = plan.groupBy("doc_id", "print", F.col("source").alias("plan_source")).agg(F.sum("taken").alias("plan_taken"), F.max("size").alias("plan_size"), F.count(F.lit(1)).alias("plan_rows"))
    plan = cut(plan.select(F.col("doc_id").alias("plan_id"), F.col("print").alias("plan_print"), "plan_source", "plan_taken", "plan_size", "plan_rows").where("plan_taken > 0"))
    body = F.col(text).cast("string")
    name = lambda c: "`" + c.replace("`", "``") + "`"
    # The row as one column, so that no name of docs can clash with those of the plan.
    single = docs.select(F.struct(*map(name, docs.columns)).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(body).alias("print"), F.col(source).cast("string").alias("source"), body.alias("body"))
    if not plan.where("plan_rows > 1").isEmpty():
        single = single.dropDuplicates(["id", "print", "source"])
    joined = single.join(plan, F.col("id").eqNullSafe(F.col("plan_id")) & F.col("print").eqNullSafe(F.col("plan_print")) & F.col("source").eqNullSafe(F.col("plan_source")))
    whole, rest = F.floor(F.col("plan_taken") / F.col("plan_size")).cast("int"), F.pmod(F.col("plan_taken"), F.col("plan_size")).cast("int")
    parts = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = joined.withColumn("plan_part", F.explode(parts))
    words = F.slice(F.regexp_extract_all("body", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), 1, F.greatest(F.col("plan_part"), F.lit(1)))
    cut_text = F.when(F.col("plan_part") < 0, F.col("body")).otherwise(F.array_join(words, ""))
    return out.select(F.col("row").withField(name(text), cut_text).alias("row")).select("row.*")
