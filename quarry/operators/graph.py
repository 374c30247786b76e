"""Dependency graphs as edge tables (src, dst): degrees, entry points, reachability, cycles, components.

Iterative operators cut their lineage to the shared checkpoint folder each round, stop when nothing changes, and delete what a later round
has taken the place of. What a walk has met is kept as parts, one a round, so that a round writes what is new alone."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Write to the folder named by spark.checkpoint.dir (a temporary one only in local mode) and read from there."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return df.checkpoint(eager=True)


def discard(*frames: DataFrame) -> None:
    """Delete the files of checkpointed frames that nothing still to run reads."""
    for df in frames:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Met:
    """Rows that a walk has met: checkpointed parts, put together when there are many."""

    MOST = 12

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > self.MOST:
            old, self.parts = self.parts[:-1], [checkpointed(reduce(DataFrame.union, self.parts[:-1])), part]
            discard(*old)

    @property
    def rows(self) -> DataFrame:
        return reduce(DataFrame.union, self.parts)


def dependency_graph(pairs: DataFrame) -> DataFrame:
    """Distinct edges without self loops and nulls."""
    return pairs.select("src", "dst").where("src <> dst").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out: one pass over the edges, summed by node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out"))


def entry_points(edges: DataFrame) -> DataFrame:
    """Nodes that nothing depends on."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def isolated(all_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return all_nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti").join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def walk(edges: DataFrame, start: DataFrame, deepest: int | None = None) -> DataFrame:
    """The columns of start and depth: breadth-first from each of its rows, which have a node and any columns that name the walk. A
    round joins the frontier with the edges; what the walk of that name has met before is not met again.

    A node with one edge into it, where no walk starts, is met once at most, so only others are looked up among those met. Where walks
    have no names, edges that were taken leave when they are half of all."""
    names = start.columns
    starts = start.select(F.col("node").alias("next")).distinct().withColumn("starts", F.lit(True))
    ways = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).withColumn("ways", F.count(F.lit(1)).over(W.partitionBy("next")))
    step = checkpointed(ways.join(starts, "next", "left").select("node", "next", (F.col("starts").isNull() & (F.col("ways") == 1)).alias("once")))
    frontier = checkpointed(start.distinct().select(*names, F.lit(0).alias("depth"), F.lit(False).alias("once")))
    met, depth, taken, size = Met(frontier), 0, 0, step.count()
    while deepest is None or depth < deepest:
        depth += 1
        ahead = frontier.drop("once", "depth").join(step, "node").select(*(F.col("next").alias("node") if c == "node" else c for c in names), "once")
        again = ahead.where("NOT once").distinct().join(met.rows.where("NOT once"), names, "left_anti")
        frontier = checkpointed(ahead.where("once").unionByName(again.select(*names, "once")).select(*names, F.lit(depth).alias("depth"), "once"))
        n = frontier.count()
        if not n:
            discard(frontier)
            break
        taken += n
        if names == ["node"] and 2 * taken > size:
            old, step = step, checkpointed(step.join(met.rows.select("node"), "node", "left_anti"))
            discard(old)
            taken, size = 0, step.count()
        met.add(frontier)
    discard(step)
    return met.rows.select(*names, "depth")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, depth: breadth-first from the start nodes."""
    return walk(edges, start.select("node"))


def components(edges: DataFrame) -> DataFrame:
    """node, group (its smallest member) of the undirected graph, by contraction: each node goes to the neighbour, or itself, that comes
    first in the order of a hash, edges go with their ends, and what is left is a smaller graph of the same components. A part of the nodes
    leaves each round, however they are numbered, so all rounds together are a few times the first. Then the steps are followed at once."""
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    both = lambda e: e.union(e.select("dst", "src")).where("src IS NOT NULL").withColumn("dst", F.coalesce("dst", "src"))
    left, steps = checkpointed(edges.select("src", "dst").distinct()), []
    while not left.isEmpty():
        first = both(left).groupBy(F.col("src").alias("node")).agg(F.min(key("dst")).alias("first"))
        step = checkpointed(first.select("node", F.least(key("node"), "first")["node"].alias("to")))
        steps.append(step)
        a, b = step.select(F.col("node").alias("src"), F.col("to").alias("a")), step.select(F.col("node").alias("dst"), F.col("to").alias("b"))
        moved = left.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        old, left = left, checkpointed(moved)
        discard(old)
    if not steps:
        return nodes(edges).select("node", F.col("node").alias("group")).limit(0)
    ends = steps[-1]
    for step in reversed(steps[:-1]):
        ahead = ends.select(F.col("node").alias("to"), F.col("to").alias("end"))
        ends = step.join(ahead, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    ends = checkpointed(ends)
    discard(left, *steps[:-1] if len(steps) > 1 else [])
    return ends.join(ends.groupBy("to").agg(F.min("node").alias("group")), "to").select("node", "group")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges left after nodes without a way in or without a way out go, again and again: cycles and what lies between them."""
    left = checkpointed(edges)
    n = left.count()
    while n:
        ins, outs = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = checkpointed(left.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
        m = left.count()
        if m == n:
            break
        n = m
    return left


def spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, color: labels carried along the edges, the smallest winning, until nothing changes."""
    while True:
        come = edges.join(labels, edges["src"] == labels["node"]).groupBy("dst").agg(F.min("color").alias("come"))
        moved = checkpointed(labels.join(come, labels["node"] == come["dst"], "left").select("node", F.col("color").alias("old"), F.least("color", F.coalesce("come", "color")).alias("color")))
        labels = moved.select("node", "color")
        if moved.where("color <> old").isEmpty():
            return labels


def cycle_groups(edges: DataFrame) -> DataFrame:
    """node, group (its smallest member): the strongly connected components of two nodes and more.

    Forward colouring finds for each node the smallest node that reaches it; walking back inside a colour from that node gives its
    component. Components found leave, and the rest is coloured again."""
    spark = edges.sparkSession
    left, found = cyclic_core(edges), None
    while not left.isEmpty():
        start = nodes(left).select("node", F.col("node").alias("color"))
        colors = checkpointed(spread(left, checkpointed(start)))
        a, b = colors.withColumnRenamed("color", "ca"), colors.withColumnRenamed("color", "cb")
        inside = left.join(a, left["src"] == a["node"]).drop("node").join(b, left["dst"] == b["node"]).where("ca = cb").select("src", "dst")
        back = checkpointed(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = colors.where("node = color").select("node")
        hit = checkpointed(reachable(back, roots).join(colors, "node").select("node", F.col("color").alias("group")))
        found = hit if found is None else checkpointed(found.union(hit))
        gone = hit.select("node")
        left = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = cyclic_core(left.select("src", "dst"))
    if found is None:
        kind = edges.schema["src"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, group {kind}")
    sizes = found.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    return found.join(sizes, "group").select("node", "group")


def ring_lengths(edges: DataFrame) -> DataFrame:
    """node, group, ring: for each node of a strongly connected group (named by its smallest member) the length of the shortest ring
    through it, however long. Distances grow from all nodes at once, inside of their groups; a node leaves when its ring has closed."""
    groups = checkpointed(cycle_groups(edges))
    a, b = groups.select(F.col("node").alias("src"), F.col("group").alias("ga")), groups.select(F.col("node").alias("dst"), F.col("group").alias("gb"))
    core = checkpointed(edges.join(a, "src").join(b, "dst").where("ga = gb").select("src", "dst"))
    step = core.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    frontier = checkpointed(core.select(F.col("src").alias("origin"), F.col("dst").alias("node")))
    met, closed, length = Met(frontier), None, 1
    while not frontier.isEmpty():
        length += 1
        ahead = checkpointed(frontier.join(step, "node").select("origin", F.col("next").alias("node")).distinct())
        done = checkpointed(ahead.where("origin = node").select(F.col("origin").alias("node"), F.lit(length).alias("ring")))
        if closed is None:
            closed = Met(done)
        else:
            closed.add(done)
        frontier = checkpointed(ahead.join(done.select(F.col("node").alias("origin")), "origin", "left_anti").select("origin", "node").join(met.rows, ["origin", "node"], "left_anti"))
        discard(ahead)
        met.add(frontier)
    discard(*met.parts)
    return groups.join(closed.rows, "node") if closed is not None else groups.withColumn("ring", F.lit(0))


def unreachable(edges: DataFrame) -> DataFrame:
    """Nodes that no entry point leads to: cycles without a way in, and what hangs off them alone."""
    return nodes(edges).join(reachable(edges, entry_points(edges)).select("node"), "node", "left_anti")


def within(edges: DataFrame, levels: int = 3) -> DataFrame:
    """src, dst, depth: what a node leads to in at most ``levels`` steps, at the least depth."""
    paths = edges.select("src", "dst", F.lit(1).alias("depth"))
    every = paths
    for k in range(2, levels + 1):
        paths = paths.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst"), F.lit(k).alias("depth")).distinct()
        every = every.union(paths)
    return every.where("src <> dst").groupBy("src", "dst").agg(F.min("depth").alias("depth"))
