"""Contexts of files: their kind, level of complexity, patterns, what packages are for, relations between files, tokens saved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.text import round_half_up, strip, token_estimate

# What well-known packages are for.
PURPOSES = {
    "ui-library": ("@mui/material", "antd", "react-bootstrap", "chakra-ui"),
    "state-management": ("redux", "zustand", "recoil", "mobx"),
    "routing": ("react-router", "next/router", "@reach/router"),
    "data-fetching": ("axios", "swr", "react-query", "@tanstack/react-query"),
    "styling": ("styled-components", "emotion", "tailwindcss"),
    "utility": ("lodash", "ramda", "uuid"),
    "validation": ("yup", "joi", "zod"),
    "date-time": ("dayjs", "moment", "date-fns"),
    "animation": ("framer-motion", "react-spring"),
    "form-handling": ("react-hook-form", "formik"),
}
# Levels with the points they begin at.
LEVELS = (("very-high", 8), ("high", 5), ("medium", 2), ("low", 0))
FUNCTIONS = ("Function", "Method")
TYPES = ("Interface", "TypeAlias", "Enum", "Import", "Export")


def _any(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def _all(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a & b, (text.contains(p) for p in parts))


def _count(*conditions: Column) -> Column:
    return reduce(lambda a, b: a + b, (F.when(c, 1).otherwise(0) for c in conditions))


def purpose(package: Column) -> Column:
    """What a package is for: by name, else by parts of its name."""
    exact = reduce(lambda a, b: a.when(package.isin(*b[1]), b[0]), PURPOSES.items(), F)
    parts = exact.when(_all(package, "react", "form"), "form-handling").when(_any(package, "test", "jest"), "testing").when(_any(package, "webpack", "babel"), "build-tool")
    return parts.when(_any(package, "style", "css"), "styling").otherwise("utility")


def patterns(content: Column) -> Column:
    """Sorted names of the component patterns that a file's text shows."""
    c = content
    rules = {
        "functional-component": _all(c, "function ", "return (") | _all(c, "const ", "=> ("),
        "class-component": _all(c, "class ", "extends Component"),
        "custom-hook": _any(c, "function use", "const use"),
        "context-provider": c.contains("createContext"),
        "context-consumer": c.contains("useContext"),
        "hoc": _any(c, "withComponent", "compose(") | c.rlike(r"return\s+function\s*\([^)]*\)\s*\{"),
        "render-props": _any(c, "children(", "render("),
        "controlled-component": _all(c, "value=", "onChange="),
        "uncontrolled-component": _any(c, "defaultValue=", "ref="),
    }
    return F.sort_array(F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items()))))


def kinds(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, kind of files(path, content): the first rule that holds, by name, by what is declared, then by text."""
    # What is exported lies under its Export.
    inner = nodes.where("depth = 1 and kind = 'Export'").select("path", F.col("node_id").alias("parent_id"))
    tops = nodes.where("depth = 1").select("path", "kind").union(nodes.where("depth = 2").join(inner, ["path", "parent_id"]).select("path", "kind"))
    at_top = tops.groupBy("path").agg(F.min(F.col("kind").isin(*TYPES)).alias("only_types"))
    rows = files.join(at_top, "path", "left").withColumn("only_types", F.coalesce("only_types", F.lit(True)))
    path, c, name = F.col("path"), F.col("content"), P.basename(F.col("path"))
    low, own = F.lower(name), F.regexp_replace(name, r"\.[tj]sx?$", "")
    shown = reduce(lambda a, b: a | b, (F.contains(c, F.concat(F.lit(x), own, F.lit(y))) for x, y in (("export default ", ""), ("export default function ", ""), ("export { ", " }"), ("export { default as ", " }"))))
    signs = _count(
        name.rlike(r"^[A-Z][a-zA-Z]*\.[tj]sx$"), _all(c, "<", "/>"), _all(c, "return (", "<"), c.contains("return <"),
        _any(c, "import React", "from 'react'") & _any(c, "export default", "export const", "export function"),
        _all(c, "props:", "React.FC"), _all(c, "interface", "Props"), c.rlike(r"<[A-Z][a-zA-Z]*"), _all(c, "children", "React"),
    )
    component = (signs >= 2) | shown
    hook = (name.rlike(r"^use[A-Z][a-zA-Z]*\.tsx?$") | c.rlike(r"export\s+(default\s+)?(?:function\s+|const\s+)use[A-Z][a-zA-Z]*")) & c.rlike(r"use(State|Effect|Context|Reducer|Memo|Callback|Ref)")
    business = _count(*(low.contains(x) for x in ("logic", "service", "controller", "handler", "processor", "manager")), _all(c, "business", "logic"), _all(c, "calculate", "process"), _all(c, "validate", "rules")) >= 2
    kind = (
        F.when(_any(name, ".test.", ".spec.") | path.contains("__tests__"), "test").when(name.rlike(r"\.(css|scss|less)$"), "style").when(_any(name, "config", "Config"), "config")
        .when(path.contains("/api/"), "api-route").when(_any(name, "middleware", "Middleware"), "middleware").when(_any(name, "constant", "Constant") | low.contains("enum"), "constant")
        .when(_any(name, ".types.", ".d.ts") | F.col("only_types"), "type-definition").when(component, "react-component").when(hook, "react-hook")
        .when(_any(name, "service", "Service", "api"), "service").when(business, "business-logic").otherwise("utility")
    )
    return rows.select("path", kind.alias("kind"))


def levels(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, points, level, tokens: lines, functions, imports and elements in steps, and one point for each pair of telling words."""
    counts = nodes.groupBy("path").agg(F.count_if(F.col("kind").isin(*FUNCTIONS)).alias("functions"), F.count_if((F.col("kind") == "Import") & (F.col("depth") == 1)).alias("imports"))
    c = F.col("content")

    def steps(x: Column, *limits: tuple[int, int]) -> Column:
        return reduce(lambda a, b: a.when(x > b[0], b[1]), limits, F).otherwise(0)

    rows = files.join(counts, "path", "left")
    total = steps(F.size(F.split(c, "\n", -1)), (200, 3), (100, 2), (50, 1)) + steps(F.coalesce("functions", F.lit(0)), (10, 2), (5, 1)) + steps(F.coalesce("imports", F.lit(0)), (15, 2), (8, 1))
    total = total + steps(F.regexp_count(c, F.lit("<[A-Z]")), (20, 2), (10, 1)) + _count(_all(c, "useEffect", "useState"), _any(c, "useContext", "useReducer"), _all(c, "async", "await"), _all(c, "try", "catch"))
    level = reduce(lambda a, b: a.when(F.col("points") >= b[1], b[0]), LEVELS, F)
    return rows.select("path", total.alias("points"), token_estimate(c).alias("tokens")).withColumn("level", level)


def relations(edges: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst, relation: resolved imports, the same backwards (extends), and up to three other files whose purpose has the same first
    word (uses). Equality joins on resolved paths and on the word; Spark keeps the first four of a word before the shuffle (a limit by group),
    so a frequent purpose costs no more than a rare one."""
    links = edges.where("src <> dst").select("src", "dst").distinct()
    both = links.select("src", "dst", F.lit("imports").alias("relation")).union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("extends")))
    word = files.select("path", F.get(F.split(F.lower("purpose"), " "), F.lit(0)).alias("word")).where("word <> ''")
    # The first four of each word are all that anyone needs; they join the rest by the word.
    first = word.withColumn("r", F.row_number().over(W.partitionBy("word").orderBy("path"))).where("r <= 4").groupBy("word").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    uses = word.join(first, "word").select(F.col("path").alias("src"), F.explode(F.slice(F.array_remove("paths", F.col("path")), 1, 3)).alias("dst"), F.lit("uses").alias("relation"))
    return both.union(uses)


def token_savings(sizes: DataFrame) -> DataFrame:
    """One row of sizes(path, original, reduced, ratio): files, both sums, the share saved in percent, the mean ratio (1 without files)."""
    saved = F.when(F.sum("original") > 0, 100.0 * (F.sum("original") - F.sum("reduced")) / F.sum("original")).otherwise(0.0)
    return sizes.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("original"), F.lit(0)).alias("original"), F.coalesce(F.sum("reduced"), F.lit(0)).alias("reduced"), round_half_up(saved, 6).alias("saved"),
        F.coalesce(round_half_up(F.avg("ratio"), 6), F.lit(1.0)).alias("mean_ratio"),
    )


def pattern_shares(files: DataFrame) -> DataFrame:
    """pattern, n, percentage: how many of files(path, content) show each pattern."""
    total = files.agg(F.count(F.lit(1)).alias("total"))
    n = files.select(F.explode(patterns(F.col("content"))).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(total)).select("pattern", "n", round_half_up(100.0 * F.col("n") / F.col("total"), 6).alias("percentage"))  # one row


def plain_lines(content: Column) -> Column:
    """struct(total, code, comment, blank) from each line by itself."""
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), "\n", -1), lambda x: F.when(strip(x) == "", "b").when(x.rlike(r"^\s*(//|/\*|\*)"), "c").otherwise("x"))
    n = lambda kind: F.size(F.filter(lines, lambda x: x == kind))
    return F.struct(F.size(lines).alias("total"), n("x").alias("code"), n("c").alias("comment"), n("b").alias("blank"))


def detailed_lines(content: Column) -> Column:
    """struct(total, code, comment, blank, mixed): block comments held from line to line; code before // counts as code and as mixed."""
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), "\n", -1), lambda x: strip(x))

    def step(s: Column, x: Column) -> Column:
        blank = x == ""
        block = ~blank & (s.open | x.contains("/*"))
        comment = block | (~blank & x.startswith("//"))
        code = ~blank & ~comment
        one = lambda c: F.when(c, 1).otherwise(0)
        return F.struct(
            F.when(block, ~x.contains("*/")).otherwise(s.open).alias("open"), (s.code + one(code)).alias("code"), (s.comment + one(comment)).alias("comment"), (s.blank + one(blank)).alias("blank"),
            (s.mixed + one(code & x.contains("//"))).alias("mixed"),
        )

    start = F.struct(F.lit(False).alias("open"), *(F.lit(0).alias(k) for k in ("code", "comment", "blank", "mixed")))
    return F.aggregate(lines, start, step, lambda s: F.struct(F.size(lines).alias("total"), s.code.alias("code"), s.comment.alias("comment"), s.blank.alias("blank"), s.mixed.alias("mixed")))


def grid(i: Column, n: Column, spacing: float = 150.0, x: float = 0.0, y: float = 0.0) -> Column:
    """struct(x, y): the place of number i of n in rows of equal length."""
    columns = F.ceil(F.sqrt(n))
    return F.struct((x + F.pmod(i, columns) * spacing).alias("x"), (y + F.floor(i / columns) * spacing).alias("y"))
