"""One nested JSON report from many result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def section(df: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """A row (name, body): the table's rows as a JSON array, in order of the columns given (all of them by default).

    A section is what a reader sees at once, so its rows are gathered; tables without such a bound are written on their own."""
    keys = order or df.columns
    rows = df.select(F.struct(*(F.col(c) for c in keys)).alias("k"), F.to_json(F.struct(*df.columns)).alias("j"))
    body = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "j"))), lambda x: x.j), ",").alias("b"))
    return body.select(F.lit(name).alias("name"), F.concat(F.lit("["), "b", F.lit("]")).alias("body"))


def report(spark: SparkSession, sections: dict[str, DataFrame]) -> DataFrame:
    """One row with the whole report as text."""
    parts = None
    for name, df in sections.items():
        part = section(df, name)
        parts = part if parts is None else parts.union(part)
    joined = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "body"))), lambda x: F.concat(F.lit('"'), x["name"], F.lit('":'), x.body)), ",").alias("b"))
    return joined.select(F.concat(F.lit("{"), "b", F.lit("}")).alias("value"))


def write_json(result: DataFrame, path: str) -> None:
    result.coalesce(1).write.mode("overwrite").text(path)


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    """Each section as JSON lines in a folder of its own, by as many tasks as it has partitions: for tables of any size."""
    for name, df in sections.items():
        df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(f"{path}/{name}")


def directory_graph(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (path, kind, depth) and edges (parent, child) of the tree of directories above the files of paths(path)."""
    parts = F.split("path", "/")
    every = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), n.alias("depth"), (n == F.size(parts)).alias("leaf")))).alias("x")).select("x.*").distinct()
    nodes = every.select("path", F.when(F.col("leaf"), "file").otherwise("directory").alias("kind"), "depth")
    edges = every.where("depth > 1").select(F.regexp_replace("path", "/[^/]*$", "").alias("parent"), F.col("path").alias("child"))
    return nodes, edges


def circular_layout(nodes: DataFrame, radius: float = 100.0) -> DataFrame:
    """node, x, y: places on a circle in order of name (for graphs that are drawn, so of a size that one can look at)."""
    from pyspark.sql import Window as W

    numbered = nodes.select("node", (F.row_number().over(W.orderBy("node")) - 1).alias("i"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"))
    angle = 2 * F.pi() * F.col("i") / F.col("n")
    return numbered.select("node", F.round(radius * F.cos(angle), 6).alias("x"), F.round(radius * F.sin(angle), 6).alias("y"))
