"""Contexts of files: over literal sources and the given texts, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import contexts as X
from quarry.plans.common import node_table, table, values
from quarry.registry import query
from quarry.sources import syntax

FILES = [
    ("src/ui/Card.tsx", "import React from 'react';\nexport const Card = (props: P) => (\n  <Box value={v} onChange={f}><Icon /></Box>\n);\n"),
    ("src/ui/Old.jsx", "class Old extends Component {\n  render() { return <p ref={r}>a</p>; }\n}\nexport default Old;\n"),
    ("src/hooks/useShop.ts", "export function useShop() {\n  const [a, b] = useState(1);\n  useEffect(() => {});\n  return a;\n}\n"),
    ("src/model/shop.ts", "export interface Shop { id: number }\nexport type Id = string;\n"),
    ("src/app/api/list.ts", "export async function GET() {\n  try { return await f(); } catch (e) { return null; }\n}\n"),
    ("src/app/shopService.ts", "export const list = 1;\nconst c = useContext(C);\n"),
    ("src/app/orderHandlerManager.ts", "export const a = 1; // one\n/* two\n three */\nconst b = 2;\n"),
    ("src/app/shop.test.ts", "const a = 1;\n"), ("src/theme.css", "p { margin: 0 }\n"), ("next.config.js", "const a = 1;\n"), ("src/middleware.ts", "const a = 1;\n"), ("src/Constants.ts", "const a = 1;\n"), ("src/lib/trim.ts", "const a = 1;\n"),
]
KINDS = [
    ("src/ui/Card.tsx", "react-component"), ("src/ui/Old.jsx", "react-component"), ("src/hooks/useShop.ts", "react-hook"), ("src/model/shop.ts", "type-definition"), ("src/app/api/list.ts", "api-route"), ("src/app/shopService.ts", "service"),
    ("src/app/orderHandlerManager.ts", "business-logic"), ("src/app/shop.test.ts", "test"), ("src/theme.css", "style"), ("next.config.js", "config"), ("src/middleware.ts", "middleware"), ("src/Constants.ts", "constant"), ("src/lib/trim.ts", "utility"),
]
PACKAGES = ["antd", "react-router", "swr", "emotion", "uuid", "zod", "moment", "formik", "react-final-form", "vitest", "babel-core", "css-loader", "left-pad", "mobx", "framer-motion"]
EDGES = [("src/ui/Card.tsx", "src/lib/trim.ts"), ("src/ui/Card.tsx", "src/model/shop.ts"), ("src/app/shopService.ts", "src/model/shop.ts"), ("src/app/shopService.ts", "src/model/shop.ts")]
PURPOSED = [("src/ui/Card.tsx", "Renders a card"), ("src/ui/Old.jsx", "renders old"), ("src/lib/trim.ts", "Trims text"), ("src/model/shop.ts", "Renders types"), ("src/a.ts", "Renders a"), ("src/b.ts", "renders b"), ("src/c.ts", None)]
SIZES = [("a", 100, 40, 0.4), ("b", 30, 30, 1.0), ("c", 7, 5, 0.714)]


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "path string, content string")


def _nodes(spark: SparkSession) -> DataFrame:
    return syntax.nodes(_files(spark).where(F.col("path").rlike(r"\.[tj]sx?$")))


@query("context_kinds", f"SELECT * FROM {values(KINDS, 'path, kind')}")
def context_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.kinds(_files(spark), _nodes(spark))


@query(
    "context_levels",
    f"""WITH {node_table(FILES)}, f AS (SELECT * FROM {values(FILES, 'path, content')}), c AS (SELECT path, count(*) FILTER (kind IN ('Function', 'Method')) AS functions, count(*) FILTER (kind = 'Import' AND depth = 1) AS imports FROM n GROUP BY 1),
    r AS (SELECT path, content, len(string_split(content, chr(10))) AS n_lines, coalesce(functions, 0) AS functions, coalesce(imports, 0) AS imports, len(regexp_extract_all(content, '<[A-Z]')) AS tags FROM f LEFT JOIN c USING (path)),
    p AS (SELECT path, content, (CASE WHEN n_lines > 200 THEN 3 WHEN n_lines > 100 THEN 2 WHEN n_lines > 50 THEN 1 ELSE 0 END + CASE WHEN functions > 10 THEN 2 WHEN functions > 5 THEN 1 ELSE 0 END
        + CASE WHEN imports > 15 THEN 2 WHEN imports > 8 THEN 1 ELSE 0 END + CASE WHEN tags > 20 THEN 2 WHEN tags > 10 THEN 1 ELSE 0 END
        + (contains(content, 'useEffect') AND contains(content, 'useState'))::INT + (contains(content, 'useContext') OR contains(content, 'useReducer'))::INT
        + (contains(content, 'async') AND contains(content, 'await'))::INT + (contains(content, 'try') AND contains(content, 'catch'))::INT)::INT AS points FROM r)
    SELECT path, points, CASE WHEN points >= 8 THEN 'very-high' WHEN points >= 5 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS level, ceil(length(content) / 4.0)::BIGINT AS tokens FROM p""",
)
def context_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.levels(_files(spark), _nodes(spark)).select("path", "points", "level", "tokens")


@query(
    "package_purposes",
    f"""WITH m AS (SELECT * FROM {values([(p, k) for k, names in X.PURPOSES.items() for p in names], 'package, purpose')}), p AS (SELECT * FROM {values([(p,) for p in PACKAGES], 'package')})
    SELECT package, coalesce(m.purpose, CASE WHEN contains(package, 'react') AND contains(package, 'form') THEN 'form-handling' WHEN contains(package, 'test') OR contains(package, 'jest') THEN 'testing'
        WHEN contains(package, 'webpack') OR contains(package, 'babel') THEN 'build-tool' WHEN contains(package, 'style') OR contains(package, 'css') THEN 'styling' ELSE 'utility' END) AS purpose FROM p LEFT JOIN m USING (package)""",
)
def package_purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = spark.createDataFrame([(p,) for p in PACKAGES], "package string")
    return packages.select("package", X.purpose(F.col("package")).alias("purpose"))


@query(
    "pattern_shares",
    f"""WITH f AS (SELECT * FROM {values(FILES, 'path, content')}), p AS (
    SELECT path, 'functional-component' AS pattern FROM f WHERE (contains(content, 'function ') AND contains(content, 'return (')) OR (contains(content, 'const ') AND contains(content, '=> (')) UNION ALL
    SELECT path, 'class-component' FROM f WHERE contains(content, 'class ') AND contains(content, 'extends Component') UNION ALL
    SELECT path, 'custom-hook' FROM f WHERE contains(content, 'function use') OR contains(content, 'const use') UNION ALL
    SELECT path, 'context-provider' FROM f WHERE contains(content, 'createContext') UNION ALL SELECT path, 'context-consumer' FROM f WHERE contains(content, 'useContext') UNION ALL
    SELECT path, 'hoc' FROM f WHERE contains(content, 'withComponent') OR contains(content, 'compose(') OR regexp_matches(content, 'return\\s+function\\s*\\([^)]*\\)\\s*\\{{') UNION ALL
    SELECT path, 'render-props' FROM f WHERE contains(content, 'children(') OR contains(content, 'render(') UNION ALL
    SELECT path, 'controlled-component' FROM f WHERE contains(content, 'value=') AND contains(content, 'onChange=') UNION ALL
    SELECT path, 'uncontrolled-component' FROM f WHERE contains(content, 'defaultValue=') OR contains(content, 'ref='))
    SELECT pattern, count(*) AS n, floor(100.0::DOUBLE * count(*) / (SELECT count(*) FROM f) * 1e6 + 0.5) / 1e6 AS percentage FROM p GROUP BY 1""",
)
def pattern_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pattern_shares(_files(spark))


@query(
    "file_relations",
    f"""WITH e AS (SELECT DISTINCT src, dst FROM {values(EDGES, 'src, dst')} WHERE src <> dst), f AS (SELECT path, string_split(lower(purpose), ' ')[1] AS word FROM {values(PURPOSED, 'path, purpose')} WHERE purpose IS NOT NULL),
    u AS (SELECT a.path AS src, b.path AS dst, row_number() OVER (PARTITION BY a.path ORDER BY b.path) AS r FROM f a JOIN f b ON a.word = b.word AND a.path <> b.path)
    SELECT src, dst, 'imports' AS relation FROM e UNION ALL SELECT dst, src, 'extends' FROM e UNION ALL SELECT src, dst, 'uses' FROM u WHERE r <= 3""",
)
def file_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.relations(spark.createDataFrame(EDGES, "src string, dst string"), spark.createDataFrame(PURPOSED, "path string, purpose string"))


@query(
    "token_savings",
    f"""SELECT count(*) AS files, sum(original)::BIGINT AS original, sum(reduced)::BIGINT AS reduced, floor(100.0::DOUBLE * (sum(original) - sum(reduced)) / sum(original) * 1e6 + 0.5) / 1e6 AS saved,
    floor(avg(ratio) * 1e6 + 0.5) / 1e6 AS mean_ratio FROM {values(SIZES, 'path, original, reduced, ratio')}""",
)
def token_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.token_savings(spark.createDataFrame(SIZES, "path string, original long, reduced long, ratio double"))


@query(
    "plain_line_counts",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents),
    k AS (SELECT doc_id, CASE WHEN regexp_full_match(x, '\s*') THEN 'b' WHEN regexp_matches(x, '^\s*(//|/\*|\*)') THEN 'c' ELSE 'x' END AS k FROM l)
    SELECT doc_id, count(*) AS n_total, count(*) FILTER (k = 'x') AS n_code, count(*) FILTER (k = 'c') AS n_comment, count(*) FILTER (k = 'b') AS n_blank FROM k GROUP BY 1""",
)
def plain_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").select("doc_id", X.plain_lines(F.col("text")).alias("n"))
    return n.select("doc_id", *(F.col(f"n.{k}").cast("long").alias(f"n_{k}") for k in ("total", "code", "comment", "blank")))


LINES = [("src/app/orderHandlerManager.ts", 5, 2, 2, 1, 1), ("src/hooks/useShop.ts", 6, 5, 0, 1, 0), ("src/lib/trim.ts", 2, 1, 0, 1, 0)]


@query("detailed_line_counts", f"SELECT * FROM {values(LINES, 'path, total, code, comment, blank, mixed')}")
def detailed_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark).where(F.col("path").isin(*(r[0] for r in LINES))).select("path", X.detailed_lines(F.col("content")).alias("n")).select("path", "n.*")


@query(
    "grid_layout",
    """WITH i AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, ceil(sqrt(count(*) OVER ()))::BIGINT AS c FROM nation)
    SELECT n_nationkey, 150.0::DOUBLE * (i % c) AS x, 150.0::DOUBLE * (i // c) AS y FROM i""",
)
def grid_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in a grid: 25 rows, so one window is in place."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "nation").select("n_nationkey", (F.row_number().over(W.orderBy("n_nationkey")) - 1).alias("i"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"))
    return rows.select("n_nationkey", X.grid(F.col("i"), F.col("n")).alias("p")).select("n_nationkey", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
