from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(rows: list[tuple], columns: str) -> str:
    """Literal rows as SQL."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, float):
            return f"{x!r}::DOUBLE"
        if isinstance(x, int):
            return str(x)
        return "'" + x.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") t({columns})"


def named(name: str, rows: list[tuple], columns: str) -> str:
    """Literal rows as a common table expression."""
    return f"{name} AS (SELECT * FROM {values(rows, columns)})"


def node_rows(files: list[tuple[str, str]]) -> list[tuple]:
    """The syntax nodes of literal sources, as rows."""
    from quarry.sources import syntax

    return [tuple(r) for path, content in files if path.endswith((".ts", ".tsx", ".js", ".jsx")) for r in syntax.parse(path, content)]


def node_table(files: list[tuple[str, str]], name: str = "n") -> str:
    """The syntax nodes of literal sources as a common table expression: what a query joins and groups, SQL joins and groups too."""
    columns = "path, node_id, parent_id, exit, depth, owner, nesting, kind, name, text, line, col"
    return named(name, node_rows(files), columns)
