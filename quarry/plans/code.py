"""Queries over a small project's sources: syntax facts and what is derived from them. Tests hold them against hand-made results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import code as C
from quarry.operators import errors as E
from quarry.registry import query
from quarry.sinks import report as S
from quarry.sources import projects as J
from quarry.sources import syntax

#: A project: path, content (fixture).
PROJECT = [
    ("package.json", '{"dependencies": {"next": "^14.1.0", "react": "18.2.0", "lodash": "4"}, "devDependencies": {"jest": "29"}}'),
    (".env", "API_KEY=abc\n# no\nPORT=3000\n"),
    ("app/page.tsx", 'import Card from "../ui/Card";\nimport { useTranslations } from "next-intl";\nexport default function Page() {\n  const t = useTranslations("home");\n  return <main><h1>{t("title")}</h1><Card items={[]} /><img src="a.png" /></main>;\n}\n'),
    ("ui/Card.tsx", 'import { Item } from "./Item";\nexport interface CardProps { items: string[]; title?: string }\nexport default function Card({ items, title }: CardProps) {\n  if (items.length > 3 && title) { for (const i of items) { if (i) continue; } }\n  return <div onClick={() => go(7)}>{title ? <b id="x">{title}</b> : null}{items.map((i) => <Item key={i} name={i} />)}<a href="/x">here</a></div>;\n}\n'),
    ("ui/Item.tsx", 'interface Props { title?: string; items: string[] }\nexport function Item({ name }: { name: string }) {\n  return <span id="x" role="buton">{name}</span>;\n}\n'),
    ("lib/data.ts", 'export async function load(id: number): Promise<string> {\n  const r = await fetch(`/api/${id}`);\n  return JSON.parse(await r.text());\n}\nexport const safe = async () => { try { return await load(42); } catch (e) { return null; } };\n'),
    ("app/api/users/route.ts", 'import { z } from "zod";\nexport async function GET() { return db.user(); }\nexport async function POST(req) { await getServerSession(); validate(req); }\n'),
    ("messages/en.json", '{"home": {"title": "Hi", "deep": {"a": "b"}}, "x": "y"}'),
    ("ui/Card.test.tsx", "test('x', () => {});\n"),
]


def project(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROJECT, "path string, content string")


def nodes(spark: SparkSession) -> DataFrame:
    return syntax.nodes(J.sources(project(spark)))


@query("function_facts")
def function_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.functions(nodes(spark)).select("path", "name", "flavour", "is_async", "line", "params", "return_type")


@query("function_complexity")
def function_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark)
    return C.functions(n).select("path", "node_id", "name").join(C.complexity(n), ["path", "node_id"]).drop("node_id")


@query("halstead_measures")
def halstead_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.halstead(nodes(spark))


@query("source_imports")
def source_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.imports(nodes(spark))


@query("source_exports")
def source_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exports(nodes(spark))


@query("react_components")
def react_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.components(nodes(spark)).drop("node_id")


@query("accessibility_findings")
def accessibility_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.accessibility_violations(C.elements(nodes(spark))).drop("node_id")


@query("type_shapes")
def type_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_types(C.type_definitions(nodes(spark))).drop("signature")


@query("magic_numbers")
def magic_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.magic_numbers(nodes(spark))


@query("translation_key_usage")
def translation_key_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.translation_keys(nodes(spark))


@query("declared_packages")
def declared_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.packages(project(spark)).withColumn("category", J.package_category(F.col("name")))


@query("project_type")
def project_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.project_type(J.packages(project(spark)))


@query("directory_graph")
def directory_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.directory_graph(project(spark).select("path"))[1]


@query("project_report")
def project_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark)
    return S.report(spark, {"components": C.components(n).drop("node_id"), "exports": C.exports(n), "accessibility": C.accessibility_violations(C.elements(n)).drop("node_id"), "errors": E.risks(n).drop("node_id")})
