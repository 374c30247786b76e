"""Modules, components and routes of a small project, with SQL over its paths, its syntax nodes and literal edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import code as C
from quarry.operators import graph as G
from quarry.operators import modules as M
from quarry.plans.common import named, node_table
from quarry.registry import query
from quarry.sources import syntax

#: A project with two cards of one name, an index, an alias, a ring of files and a package that has a component of a local name.
PROJECT = [
    ("src/app/page.tsx", 'import Card from "../ui/Card";\nimport { Item as Row } from "@/ui/Item";\nimport { Button } from "ui-lib";\nimport * as K from "./kit";\nimport "./page.css";\nexport default function Page({ ok, kind }) {\n  if (ok) return <Row />;\n  switch (kind) { case 1: return <Empty />; default: break; }\n  return <main><Card>{ok && <Button />}</Card>{kind ? <Row /> : <K.Panel />}<p>text</p></main>;\n}\nconst Empty = () => <div />;\n'),
    ("src/app/shop/[id]/page.tsx", 'import { Card } from "../../../shop/Card";\nimport lodash from "lodash/get";\nexport default function Shop() { return <Card />; }\n'),
    ("src/ui/Card.tsx", 'import { Frame } from "./Frame";\nexport default function Card({ children }) { return <Frame>{children}</Frame>; }\n'),
    ("src/ui/Item.tsx", 'import Card from "./Card";\nexport const Item = () => <li><Card /></li>;\n'),
    ("src/ui/Frame/index.tsx", 'import { Item } from "../Item";\nexport function Frame(p) { return <div>{p.children}<Item /></div>; }\n'),
    ("src/shop/Card.tsx", 'export function Card() { const a = price(1); return <span>{a}<Only /></span>; }\nfunction price(n) { return tax(n); }\nfunction tax(n) { return n; }\n'),
    ("src/misc/Only.tsx", 'export function Only() { return <i>x</i>; }\n'),
    ("src/app/kit.ts", "export const Panel = null;\n"),
]
ROUTES = [("/", "src/app/page.tsx", "Page"), ("/shop/:id", "src/app/shop/[id]/page.tsx", "Shop")]


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROJECT, "path string, content string")


def _nodes(spark: SparkSession) -> DataFrame:
    return syntax.nodes(_files(spark))


_PATHS = named("f", [(p,) for p, _ in PROJECT], "path")
_BARE = "regexp_replace({0}, '\\.(js|jsx|ts|tsx)$', '')"
#: What each import names, folded by hand: importer, specifier, path meant.
MEANT = [
    ("src/app/page.tsx", "../ui/Card", "src/ui/Card"), ("src/app/page.tsx", "@/ui/Item", "ui/Item"), ("src/app/page.tsx", "ui-lib", "ui-lib"), ("src/app/page.tsx", "./kit", "src/app/kit"), ("src/app/page.tsx", "./page.css", "src/app/page.css"),
    ("src/app/shop/[id]/page.tsx", "../../../shop/Card", "src/shop/Card"), ("src/app/shop/[id]/page.tsx", "lodash/get", "lodash/get"), ("src/ui/Card.tsx", "./Frame", "src/ui/Frame"), ("src/ui/Item.tsx", "./Card", "src/ui/Card"), ("src/ui/Frame/index.tsx", "../Item", "src/ui/Item"),
]
_INDEX = f"""{_PATHS}, bare AS (SELECT path, {_BARE.format('path')} AS b FROM f), keys AS (SELECT path AS target, b AS key, 0 AS rank FROM bare UNION ALL SELECT path, regexp_replace(b, '/index$', ''), 1 FROM bare UNION ALL SELECT path, regexp_replace(b, '^src/', ''), 2 FROM bare UNION ALL SELECT path, regexp_replace(regexp_replace(b, '/index$', ''), '^src/', ''), 3 FROM bare),
    idx AS (SELECT key, arg_min(target, rank * 1000 + length(target)) AS target FROM keys GROUP BY key), {named("i", MEANT, "path, specifier, meant")}, r AS (SELECT i.path, specifier, target, NOT regexp_matches(specifier, '^(\\./|\\.\\./|@/|/|app/|pages/|components/|lib/|utils/|hooks/|types/|src/|styles/)|\\.(css|scss|sass|less)$') AND target IS NULL AS external FROM i LEFT JOIN idx ON key = meant)"""


@query("resolved_imports", f"WITH {_INDEX} SELECT path, specifier, target, external, CASE WHEN external THEN split_part(specifier, '/', 1) END AS package FROM r")
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each import with the file of the project that it means, or the package."""
    found = M.resolved(C.imports(_nodes(spark)), _files(spark))
    return found.select("path", "specifier", "target", "external", "package")


@query("file_dependencies", f"WITH {_INDEX} SELECT DISTINCT path AS src, target AS dst FROM r WHERE target IS NOT NULL AND target <> path")
def file_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.file_edges(C.imports(_nodes(spark)), _files(spark))


@query(
    "circular_files",
    f"""WITH RECURSIVE {_INDEX}, e AS (SELECT DISTINCT path AS src, target AS dst FROM r WHERE target IS NOT NULL AND target <> path), walk AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM walk w JOIN e ON e.src = w.dst)
    SELECT a.src AS node, min(a.dst) AS "group" FROM walk a JOIN walk b ON a.src = b.dst AND a.dst = b.src GROUP BY 1""",
)
def circular_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.circular_files(M.file_edges(C.imports(_nodes(spark)), _files(spark)))


_N = node_table(PROJECT)
_BOUND = f"{_N}, names AS (SELECT i.path, i.name AS specifier, b.name AS local, b.text AS imported FROM n i JOIN n b ON b.path = i.path AND b.parent_id = i.node_id AND b.kind = 'ImportName' WHERE i.kind = 'Import')"


@query("external_packages", f"WITH {_BOUND} SELECT split_part(specifier, '/', 1) AS package, count(DISTINCT path) AS n_files, array_to_string(list_sort(list(DISTINCT local)), ',') AS names FROM names WHERE specifier IN ('ui-lib', 'lodash/get') GROUP BY 1")
def external_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.external_packages(M.bound_names(_nodes(spark)), _files(spark))
    return found.select("package", "n_files", F.array_join("names", ",").alias("names"))


#: Components and the imports looked up among them (literal).
KNOWN = [("src/ui/Card.tsx", "Card", "Card"), ("src/shop/Card.tsx", "Card", "Card,price"), ("src/ui/List.tsx", "List", "List"), ("src/ui/List.tsx", "ListItem", "ListItem"), ("src/deep/Menu/index.tsx", "Menu", "Menu,open")]
ASKED = [("a.tsx", "Card"), ("a.tsx", "src/ui/List"), ("a.tsx", "./ui/List"), ("b.tsx", "src/shop/Card.tsx"), ("b.tsx", "/src/ui/List"), ("c.tsx", "./Menu"), ("c.tsx", "lib/open"), ("c.tsx", "List"), ("d.tsx", "x/price"), ("d.tsx", "./deep"), ("d.tsx", "nothing")]
_KNOWN = f"{named('c', KNOWN, 'path, name, exports')}, {named('a', ASKED, 'path, specifier')}"


def _known(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(KNOWN, "path string, name string, exports string").withColumn("exports", F.split("exports", ",")), spark.createDataFrame(ASKED, "path string, specifier string")


@query(
    "component_lookup",
    f"""WITH {_KNOWN}, k AS (SELECT DISTINCT path, name, unnest([name, regexp_extract(path, '([^/]*)\\.[^.]*$', 1), {_BARE.format('path')}, path, regexp_replace(path, '/[^/]*$', '') || '/' || regexp_extract(path, '([^/]*)\\.[^.]*$', 1)]) AS key FROM c)
    SELECT DISTINCT a.path, a.specifier, k.path AS target, k.name FROM a JOIN k ON k.key = regexp_replace(regexp_replace({_BARE.format('a.specifier')}, '^\\./', ''), '^/', '')""",
)
def component_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports to components through every name that a component may be called by."""
    known, asked = _known(spark)
    return M.looked_up(asked, known)


@query(
    "component_by_name",
    f"""WITH {_KNOWN}, w AS (SELECT *, regexp_replace(regexp_extract(specifier, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS base FROM a), s AS (SELECT *, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem FROM c),
    h AS (SELECT w.path, w.specifier, (SELECT min(c.path) FROM c WHERE c.name = base) AS target, base AS name, 1 AS way FROM w UNION ALL
    SELECT w.path, specifier, s.path, s.name, 2 FROM w JOIN s ON s.stem = base WHERE s.path = (SELECT min(path) FROM s s2 WHERE s2.stem = base) UNION ALL
    SELECT w.path, specifier, c.path, c.name, 3 FROM w JOIN c ON starts_with(specifier, '.') AND (list_contains(string_split(c.path, '/'), base) OR list_contains(string_split(c.path, '/'), base || '.tsx')) UNION ALL
    SELECT w.path, specifier, c.path, c.name, 4 FROM w JOIN c ON list_contains(string_split(exports, ','), base)), g AS (SELECT * FROM h WHERE target IS NOT NULL)
    SELECT DISTINCT path, specifier, target, name, way FROM (SELECT *, min(way) OVER (PARTITION BY path, specifier) AS least FROM g) WHERE way = least""",
)
def component_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, asked = _known(spark)
    return M.found_by_name(asked, known)


#: Edges as they must come out, by reading the project.
EDGES = [
    ("src/app/page.tsx", "Page", "src/ui/Card.tsx", "Card", False, False), ("src/app/page.tsx", "Page", "src/ui/Item.tsx", "Item", False, True), ("src/app/page.tsx", "Page", None, "Button", True, True),
    ("src/app/page.tsx", "Page", "src/app/page.tsx", "Empty", False, True), ("src/app/page.tsx", "Page", None, "K.Panel", True, True), ("src/app/shop/[id]/page.tsx", "Shop", "src/shop/Card.tsx", "Card", False, False),
    ("src/ui/Card.tsx", "Card", "src/ui/Frame/index.tsx", "Frame", False, False), ("src/ui/Item.tsx", "Item", "src/ui/Card.tsx", "Card", False, False), ("src/ui/Frame/index.tsx", "Frame", "src/ui/Item.tsx", "Item", False, False),
    ("src/shop/Card.tsx", "Card", "src/misc/Only.tsx", "Only", False, False),
]
_EDGE = "src_path, src, dst_path, dst, external, in_choice"
_EDGE_KINDS = "src_path string, src string, dst_path string, dst string, external boolean, in_choice boolean"


@query("component_edges", f"WITH {named('e', EDGES, _EDGE)} SELECT * FROM e")
def component_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which component each tag means; the SQL holds the edges that reading the sources gives."""
    return M.project_edges(_nodes(spark), _files(spark))


_LITERAL = f"{named('e', EDGES, _EDGE)}, {named('r', ROUTES, 'route, path, name')}"
_FLOW = f"""{_LITERAL}, walk AS (SELECT route, path, name, false AS external, 0 AS depth, [path || '#' || name] AS seen FROM r UNION ALL
    SELECT w.route, e.dst_path, e.dst, e.external, w.depth + 1, list_append(w.seen, coalesce(e.dst_path || '#', '') || e.dst) FROM walk w JOIN e ON NOT w.external AND e.src_path = w.path AND e.src = w.name WHERE w.depth < 9 AND NOT list_contains(w.seen, coalesce(e.dst_path || '#', '') || e.dst)),
    flow AS (SELECT route, path, name, external, min(depth)::INT AS depth FROM walk GROUP BY ALL)"""


def _flow(spark: SparkSession) -> DataFrame:
    return M.flow(spark.createDataFrame(ROUTES, "route string, path string, name string"), spark.createDataFrame(EDGES, _EDGE_KINDS))


@query("component_flow", f"WITH RECURSIVE {_FLOW} SELECT route, path, name, external, depth FROM flow")
def component_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each route's page leads to, at most ten levels deep, at the depth at which it is first met."""
    return _flow(spark).select("route", "path", "name", "external", "depth")


CHOICES = [("src/app/page.tsx", "Page", 4), ("src/ui/Item.tsx", "Item", 1)]
_STATS = f"""{_FLOW}, {named('c', CHOICES, 'path, name, n')}, s AS (SELECT route, count(*) AS components, count_if(external) AS external, count_if(NOT external) AS internal, max(depth) AS depth, sum(coalesce(n, 0))::BIGINT AS conditionals FROM flow LEFT JOIN c USING (path, name) GROUP BY route)"""


@query("flow_statistics", f"WITH RECURSIVE {_STATS} SELECT *, CASE WHEN depth > 5 OR conditionals > 10 THEN 'force' WHEN components < 10 THEN 'circular' ELSE 'hierarchical' END AS layout, CASE WHEN depth > 5 THEN 'horizontal' ELSE 'vertical' END AS direction, components + 2 * conditionals AS weight FROM s")
def flow_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.flow_statistics(_flow(spark), spark.createDataFrame(CHOICES, "path string, name string, n long"))


@query(
    "flow_summary",
    f"""WITH RECURSIVE {_STATS}, u AS (SELECT path, name, arg_min(depth, (route, depth)) AS depth FROM flow GROUP BY 1, 2)
    SELECT (SELECT count(*) FROM s) AS routes, count(*) AS components, sum(coalesce(n, 0))::BIGINT AS conditionals, floor(sum(depth) / (SELECT count(*) FROM s) * 100 + 0.5) / 100 AS average_depth, (SELECT arg_max(route, (components + 2 * conditionals)) FROM s) AS most_complex FROM u LEFT JOIN c USING (path, name)""",
)
def flow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = spark.createDataFrame(CHOICES, "path string, name string, n long")
    found = _flow(spark)
    return M.flow_summary(found, M.flow_statistics(found, choices), choices)


_OUTER = "outer_ AS (SELECT path, node_id AS f, exit AS f_exit, name FROM n WHERE kind = 'Function' AND regexp_matches(name, '^[A-Z]'))"


@query(
    "conditional_renders",
    f"""WITH {_N}, {_OUTER}, c AS (SELECT n.path, n.node_id, n.kind, n.line, n.col, CASE WHEN n.kind = 'Logical' THEN p.exit ELSE n.exit END AS until FROM n JOIN n p ON p.path = n.path AND p.node_id = n.parent_id WHERE n.kind IN ('Conditional', 'Logical', 'If', 'Switch'))
    SELECT c.path, (SELECT arg_min(o.name, o.f) FROM outer_ o WHERE o.path = c.path AND c.node_id > o.f AND c.node_id <= o.f_exit) AS name, CASE c.kind WHEN 'Conditional' THEN 'ternary' WHEN 'Logical' THEN 'logical_and' WHEN 'If' THEN 'if' ELSE 'switch' END AS kind, c.line, c.col
    FROM c WHERE EXISTS (SELECT 1 FROM n m WHERE m.kind = 'JsxElement' AND m.path = c.path AND m.node_id > c.node_id AND m.node_id <= c.until) AND EXISTS (SELECT 1 FROM outer_ o WHERE o.path = c.path AND c.node_id > o.f AND c.node_id <= o.f_exit)""",
)
def conditional_renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.conditional_renders(_nodes(spark))


@query(
    "returned_markup",
    f"""WITH {_N}, o AS (SELECT path, node_id, name, text FROM n WHERE kind = 'Function' AND regexp_matches(name, '^[A-Z]')), r AS (SELECT n.path, n.owner, n.nesting, p.kind IN ('Case', 'Default') AS in_case FROM n JOIN n p ON p.path = n.path AND p.node_id = n.parent_id
    WHERE n.kind = 'Return' AND EXISTS (SELECT 1 FROM n m WHERE m.kind = 'JsxElement' AND m.path = n.path AND m.owner = n.owner AND m.node_id > n.node_id AND m.node_id <= n.exit)), t AS (SELECT path, owner, count(*) AS every FROM n WHERE kind = 'Return' GROUP BY 1, 2)
    SELECT o.path, o.name, count(*) AS n_returns, count_if(r.nesting > 0) AS early, contains(o.text, 'arrow') AND any_value(t.every) = 1 AND count_if(r.nesting > 0) = 0 AS single_arrow, bool_or(r.in_case) AS in_switch FROM r JOIN o ON o.path = r.path AND o.node_id = r.owner JOIN t ON t.path = r.path AND t.owner = r.owner GROUP BY o.path, o.name, o.node_id, o.text""",
)
def returned_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.returned_markup(_nodes(spark))


@query(
    "function_calls",
    f"""WITH {_N}, f AS (SELECT path, node_id, name FROM n WHERE kind = 'Function' AND name IS NOT NULL) SELECT DISTINCT c.path || '#' || a.name AS src, c.path || '#' || b.name AS dst FROM n c JOIN f a ON a.path = c.path AND a.node_id = c.owner JOIN f b ON b.path = c.path AND b.name = c.name WHERE c.kind = 'Call' AND a.name <> b.name""",
)
def function_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.call_graph(_nodes(spark))


@query("pages_using_components", f"WITH {_LITERAL} SELECT e.dst_path AS path, e.dst AS name, array_to_string(list_sort(list(DISTINCT route)), ',') AS pages FROM e JOIN r ON r.path = e.src_path AND r.name = e.src WHERE NOT external GROUP BY 1, 2")
def pages_using_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.pages_using(spark.createDataFrame(EDGES, _EDGE_KINDS), spark.createDataFrame(ROUTES, "route string, path string, name string"))
    return found.select("path", "name", F.array_join("pages", ",").alias("pages"))


@query("tracked_elements", f"WITH {_N} SELECT path, name AS tag, count(*) AS n FROM n WHERE kind = 'JsxElement' AND regexp_matches(name, '^[a-z0-9]+$') AND name <> 'main' GROUP BY 1, 2")
def tracked_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tracked_elements(_nodes(spark), leave_out=("main",))


@query("unused_components", f"WITH {named('e', EDGES, _EDGE)}, {named('c', [('src/app/page.tsx', 'Page'), ('src/app/page.tsx', 'Empty'), ('src/app/shop/[id]/page.tsx', 'Shop'), ('src/ui/Card.tsx', 'Card'), ('src/ui/Item.tsx', 'Item'), ('src/ui/Frame/index.tsx', 'Frame'), ('src/shop/Card.tsx', 'Card'), ('src/misc/Only.tsx', 'Only')], 'path, name')} SELECT path, name FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.dst_path = c.path AND e.dst = c.name)")
def unused_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that no other uses: pages, and what is left over."""
    n = G.checkpointed(_nodes(spark))
    used = M.project_edges(n, _files(spark)).where("not external").select(F.col("dst_path").alias("path"), F.col("dst").alias("name"))
    return C.components(n).select("path", "name").join(used, ["path", "name"], "left_anti")
