"""Audits over literal facts, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import round_half_up
from quarry.operators import audits as A
from quarry.plans.common import table, values
from quarry.registry import query


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


NAMES = [("Card", "return <div/>"), ("card", "return <div/>"), ("handleClick", None), ("HandleClick", None), ("OnBoard", "x"), ("List", "=> (\n <ul/>"), ("_Base", None), ("isOpen", None), ("Form", "const a = 1")]


@query(
    "component_predicate",
    f"SELECT name, regexp_matches(name, '^[^a-z]') AND NOT regexp_matches(name, '{A.VERB_PATTERN}') AND (content IS NULL OR regexp_matches(content, '{A.MARKUP_PATTERN}')) AS is_component FROM {values(NAMES, 'name, content')}",
)
def component_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, NAMES, "name string, content string").select("name", A.is_component(F.col("name"), F.col("content")).alias("is_component"))


IMAGES = [("a.png", 1, 0, 0, 0, 0, 0, 0), ("b.webp", 0, 0, 1, 1, 1, 1, 1), ("c.gif", 3, 2, 1, 0, 1, 0, 0), ("d.jpg", 0, 1, 2, 1, 0, 0, 1)]
_IMG = "src, high, medium, low, optimised, lazy, priority, placeholder"


@query(
    "image_scores",
    f"""SELECT src, CASE lower(regexp_extract(src, '\\.([a-z]+)$', 1)) WHEN 'jpg' THEN 'JPEG' WHEN 'png' THEN 'PNG' WHEN 'gif' THEN 'GIF' WHEN 'webp' THEN 'WebP' END AS format,
    greatest(0, least(100, 100 - 25 * high - 15 * medium - 5 * low + 10 * optimised + 10 * lazy + 10 * priority + 5 * placeholder)) AS score FROM {values(IMAGES, _IMG)}""",
)
def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, IMAGES, _IMG.replace(",", " int,").replace("src int", "src string") + " int")
    ext = F.lower(F.regexp_extract("src", r"\.([a-z]+)$", 1))
    form = F.when(ext.isin("jpg", "jpeg"), "JPEG").when(ext == "png", "PNG").when(ext == "gif", "GIF").when(ext == "webp", "WebP").when(ext == "svg", "SVG").when(ext == "avif", "AVIF")
    yes = lambda c: F.col(c) == 1
    return rows.select("src", form.alias("format"), A.image_score(F.col("high"), F.col("medium"), F.col("low"), yes("optimised"), yes("lazy"), yes("priority"), yes("placeholder")).alias("score"))


ROUTES = [("/", 95.0, 1, 1, 0, 0, 0), ("/a/:id", 40.0, 0, 0, 1, 0, 2), ("/b/*", 80.0, 1, 0, 1, 1, 4), ("/c", 60.0, 1, 0, 0, 0, 1), ("/d", 89.0, 1, 1, 0, 0, 1)]
_ROUTE = "route, coverage, layout, error, dynamic, catch_all, depth"
_POINTS = """CASE WHEN coverage < 50 THEN 3 WHEN coverage < 75 THEN 2 WHEN coverage < 90 THEN 1 ELSE 0 END + CASE WHEN layout = 0 THEN 2 ELSE 0 END + CASE WHEN error = 0 THEN 1 + 2 * dynamic ELSE 0 END + dynamic + catch_all + CASE WHEN depth > 3 THEN 1 ELSE 0 END"""


@query(
    "route_risk",
    f"SELECT route, points, CASE WHEN points >= 6 THEN 'critical' WHEN points >= 4 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT route, {_POINTS} AS points FROM {values(ROUTES, _ROUTE)})",
)
def route_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _frame(spark, ROUTES, "route string, coverage double, layout int, error int, dynamic int, catch_all int, depth int")
    points, level = A.route_risk(F.col("coverage"), *(F.col(c) == 1 for c in ("layout", "error", "dynamic", "catch_all")), F.col("depth"))
    return r.select("route", points.alias("points"), level.alias("risk"))


APP = [("app/page.tsx",), ("app/layout.tsx",), ("app/error.tsx",), ("app/shop/page.tsx",), ("app/shop/loading.tsx",), ("app/shop/[id]/page.tsx",), ("app/shop/[id]/layout.tsx",), ("app/shop/[id]/not-found.jsx",), ("lib/x.ts",)]
_APP = f"""f AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)\\.[jt]sx?$', 1) AS kind FROM {values(APP, 'path')} WHERE path LIKE 'app/%'),
k AS (SELECT unnest(['layout', 'template', 'error', 'loading', 'not-found']) AS kind),
m AS (SELECT p.path, s.kind, max_by(s.path, length(s.dir)) AS found, count(*) AS n FROM f p JOIN f s ON p.kind = 'page' AND s.kind <> 'page' AND (p.dir = s.dir OR starts_with(p.dir, s.dir || '/')) GROUP BY 1, 2)"""


@query("special_file_coverage", f"WITH {_APP} SELECT p.path, k.kind, m.found, coalesce(m.n, 0) AS n FROM (SELECT path FROM f WHERE kind = 'page') p CROSS JOIN k LEFT JOIN m ON m.path = p.path AND m.kind = k.kind")
def special_file_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.special_files(_frame(spark, APP, "path string"))


@query(
    "route_coverage",
    f"""WITH {_APP} SELECT p.path, count(m.found) AS existing, count(*) AS required, floor(count(m.found) * 10000.0 / count(*) + 0.5) / 100 AS coverage FROM (SELECT path FROM f WHERE kind = 'page') p CROSS JOIN k LEFT JOIN m ON m.path = p.path AND m.kind = k.kind GROUP BY p.path""",
)
def route_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.special_files(_frame(spark, APP, "path string"))
    return s.groupBy("path").agg(F.count("found").alias("existing"), F.count(F.lit(1)).alias("required"), round_half_up(100 * F.count("found") / F.count(F.lit(1)), 2).alias("coverage"))


@query("missing_special_files", f"WITH {_APP} SELECT k.kind, count(*) AS n FROM (SELECT path FROM f WHERE kind = 'page') p CROSS JOIN k LEFT JOIN m ON m.path = p.path AND m.kind = k.kind WHERE m.found IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def missing_special_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.special_files(_frame(spark, APP, "path string")).where("found is null")
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind").limit(5)


@query(
    "layout_hierarchy",
    f"""WITH {_APP}, l AS (SELECT path, dir FROM f WHERE kind = 'layout') SELECT a.path, max_by(b.path, length(b.dir)) AS parent, count(b.path) AS ancestors FROM l a LEFT JOIN l b ON a.dir <> b.dir AND starts_with(a.dir, b.dir || '/') GROUP BY a.path""",
)
def layout_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout's parent, by a join on each directory above it."""
    dirs = _frame(spark, APP, "path string").where(F.col("path").rlike(r"(^|/)layout\.[jt]sx?$")).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    above = dirs.select("path", F.explode(A.ancestors(F.col("dir"))).alias("up"), "dir").where("up <> dir")
    met = above.join(dirs.select(F.col("dir").alias("up"), F.col("path").alias("other")), "up").groupBy("path").agg(F.max_by("other", F.length("up")).alias("parent"), F.count(F.lit(1)).alias("ancestors"))
    return dirs.select("path").join(met, "path", "left").select("path", "parent", F.coalesce("ancestors", F.lit(0)).alias("ancestors"))


TAGS = [("A", 0, "div", 1), ("A", 1, "p", 2), ("A", 1, "b", 1), ("B", 0, "div", 1), ("B", 1, "p", 1), ("B", 2, "i", 1), ("C", 0, "ul", 1), ("C", 1, "li", 4), ("D", 0, "ul", 1), ("D", 1, "li", 3)]
PAIRS = [("A", "B"), ("A", "C"), ("C", "D")]


@query(
    "depth_similarity",
    f"""WITH t AS (SELECT * FROM {values(TAGS, 'component, depth, tag, n')}), p AS (SELECT * FROM {values(PAIRS, 'a, b')}),
    x AS (SELECT a, b, depth, tag, n AS na, 0 AS nb FROM p JOIN t ON component = a UNION ALL SELECT a, b, depth, tag, 0, n FROM p JOIN t ON component = b),
    y AS (SELECT a, b, depth, tag, sum(na) AS na, sum(nb) AS nb FROM x GROUP BY ALL), z AS (SELECT a, b, depth, avg(least(na, nb) / greatest(na, nb)) AS s FROM y GROUP BY ALL)
    SELECT a, b, floor(avg(s) * 10000 + 0.5) / 10000 AS similarity FROM z GROUP BY a, b""",
)
def depth_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.depth_similarity(_frame(spark, TAGS, "component string, depth int, tag string, n int"), _frame(spark, PAIRS, "a string, b string"))


STYLES = [("A", "B", "card box", "box card wide"), ("A", "C", "card", ""), ("C", "D", "", ""), ("B", "D", "x", "y")]
_LIST = "list_filter(string_split({0}, ' '), lambda v: v <> '')"


@query(
    "style_similarity",
    f"""SELECT a, b, CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 1.0 ELSE floor(len(list_intersect(x, y)) * 1000.0 / len(list_distinct(list_concat(x, y))) + 0.5) / 1000 END AS similarity
    FROM (SELECT a, b, {_LIST.format('ca')} AS x, {_LIST.format('cb')} AS y FROM {values(STYLES, 'a, b, ca, cb')})""",
)
def style_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = lambda c: F.filter(F.split(c, " "), lambda v: v != "")
    return _frame(spark, STYLES, "a string, b string, ca string, cb string").select("a", "b", round_half_up(A.jaccard(split("ca"), split("cb"), 1.0), 3).alias("similarity"))


SCORES = [("A", "B", 1.0, 0.9, 0.8, 1.0, 0.5), ("A", "C", 0.5, 0.5, 0.5, 0.5, 0.9), ("C", "D", 0.0, 0.0, 0.0, 0.1, 1.0)]


@query(
    "duplicate_score",
    f"SELECT a, b, greatest(0.0, floor((props * 0.4 + (base + child + style) / 3 * 0.6 - CASE WHEN common > 0.7 THEN (common - 0.7) * 0.5 ELSE 0.0 END) * 100 + 0.5) / 100) AS score FROM (SELECT a, b, props::DOUBLE AS props, base::DOUBLE AS base, child::DOUBLE AS child, style::DOUBLE AS style, common::DOUBLE AS common FROM {values(SCORES, 'a, b, props, base, child, style, common')})",
)
def duplicate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("props", "base", "child", "style", "common")
    rows = _frame(spark, SCORES, "a string, b string, " + ", ".join(f"{n} double" for n in names))
    return rows.select("a", "b", A.duplicate_score(*map(F.col, names)).alias("score"))


QUALITY = [("f", 0, 0, 0, "string", 2, 1, "return 1"), ("g", 2, 1, 3, "unknown", 0, 0, ""), ("h", 6, 0, 0, None, 1, 0, "x"), ("i", 0, 2, 1, "", 0, 3, " ")]


@query(
    "function_quality",
    f"""SELECT name, greatest(0, least(100, 100 - 20 * errors - 10 * warnings - 2 * infos + CASE WHEN coalesce(return_type, '') NOT IN ('', 'unknown') THEN 5 ELSE 0 END + CASE WHEN deps > 0 THEN 3 ELSE 0 END + CASE WHEN calls > 0 THEN 3 ELSE 0 END + CASE WHEN trim(body) <> '' THEN 5 ELSE 0 END)) AS score
    FROM {values(QUALITY, 'name, errors, warnings, infos, return_type, deps, calls, body')}""",
)
def function_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, QUALITY, "name string, errors int, warnings int, infos int, return_type string, deps int, calls int, body string")
    return rows.select("name", A.function_quality(*(F.col(c) for c in ("errors", "warnings", "infos", "return_type", "deps", "calls", "body"))).alias("score"))


TYPES = [("User", "Person", "id name mail", "id name age", "save", "save load", "Base", "Base"), ("A", "B", "x", "y", "", "", "", ""), ("P", "Q", "a b", "a b", "m", "m", "", "Z")]


def _jac(x: str, y: str) -> str:
    a, b = _LIST.format(x), _LIST.format(y)
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


@query(
    "type_similarity",
    f"SELECT a, b, floor(({_jac('pa', 'pb')} * 0.6 + {_jac('ma', 'mb')} * 0.3 + {_jac('ea', 'eb')} * 0.1) * 1000 + 0.5) / 1000 AS similarity FROM {values(TYPES, 'a, b, pa, pb, ma, mb, ea, eb')}",
)
def type_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = lambda c: F.filter(F.split(c, " "), lambda v: v != "")
    rows = _frame(spark, TYPES, "a string, b string, pa string, pb string, ma string, mb string, ea string, eb string")
    return rows.select("a", "b", A.type_similarity(*(A.jaccard(split(x), split(y)) for x, y in (("pa", "pb"), ("ma", "mb"), ("ea", "eb")))).alias("similarity"))


CONFIGURED = [("one", "x-frame-options"), ("one", "Content-Security-Policy"), ("two", "Referrer-Policy")]


@query(
    "missing_security_headers",
    f"""SELECT p.project, h.header, h.severity FROM (SELECT unnest(['one', 'two', 'three']) AS project) p CROSS JOIN (SELECT * FROM {values(list(A.HEADERS), 'header, severity')}) h
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM {values(CONFIGURED, 'project, header')}) c WHERE c.project = p.project AND lower(c.header) = lower(h.header))""",
)
def missing_security_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.missing_headers(_frame(spark, CONFIGURED, "project string, header string"), _frame(spark, [("one",), ("two",), ("three",)], "project string"))


STRUCTURED = [("p1", "Product", "@context @type name brand"), ("p2", "Article", "@type headline"), ("p3", "Event", "@context @type name url image description"), ("p4", "FAQPage", "")]


def _coverage_sql() -> str:
    def one(needed: list[str], wanted: list[str]) -> str:
        share = lambda names: f"len(list_intersect(p, [{', '.join(repr(n) for n in names)}]))::DOUBLE / {len(names)}"
        return f"floor(100 * (0.7 * ({share(needed)}) + 0.3 * ({share(wanted)})) + 0.5)::BIGINT"

    cases = " ".join(f"WHEN '{k}' THEN {one(*v)}" for k, v in A.SCHEMAS.items())
    return f"CASE kind {cases} ELSE {one(['@context', '@type'], ['name', 'description', 'url', 'image'])} END"


@query("schema_coverage", f"SELECT page, kind, {_coverage_sql()} AS coverage FROM (SELECT page, kind, {_LIST.format('props')} AS p FROM {values(STRUCTURED, 'page, kind, props')})")
def schema_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, STRUCTURED, "page string, kind string, props string")
    return rows.select("page", "kind", A.schema_coverage(F.col("kind"), F.filter(F.split("props", " "), lambda v: v != "")).alias("coverage"))


HEAVY = [("lodash", "large", 2, 0, 0, 1), ("zod", "medium", 0, 0, 1, 0), ("tiny", "small", 5, 0, 0, 0), ("charts", "large", 0, 1, 1, 0), ("date-fns", "medium", 4, 1, 0, 0)]
_HEAVY = "name, size, pages, server, dynamic, shaking"
_IMPACT = "CASE size WHEN 'large' THEN 3 WHEN 'medium' THEN 1 ELSE 0 END + pages * 2 + CASE WHEN server = 0 THEN 2 ELSE 0 END + CASE WHEN dynamic = 0 AND pages > 0 THEN 3 ELSE 0 END + 2 * shaking - dynamic"


@query(
    "import_impact",
    f"""SELECT name, CASE WHEN points >= 6 THEN 'high' WHEN points >= 3 THEN 'medium' ELSE 'low' END AS impact, shaking = 1 OR (size = 'large' AND pages > 0) OR (size <> 'small' AND dynamic = 0 AND (server = 0 OR pages > 3)) AS flagged
    FROM (SELECT *, {_IMPACT} AS points FROM {values(HEAVY, _HEAVY)})""",
)
def import_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, HEAVY, "name string, size string, pages int, server int, dynamic int, shaking int")
    args = (F.col("size"), F.col("pages"), F.col("server") == 1, F.col("dynamic") == 1, F.col("shaking") == 1)
    return rows.select("name", A.import_impact(*args).alias("impact"), A.flag_import(*args).alias("flagged"))


SITES = [("one", 1, 2, 0, 3, 1, 4), ("two", 9, 0, 9, 0, 0, 0), ("three", 0, 0, 0, 0, 0, 0)]
_PART = "greatest(0, 100 - {0} * {1})"


@query(
    "health_score",
    "SELECT site, floor("
    + " + ".join(f"{_PART.format(c, k)} * {w}" for (c, w), k in zip(A.HEALTH.items(), (15, 10, 12, 8, 10, 12), strict=True))
    + f" + 0.5)::BIGINT AS score FROM {values(SITES, 'site, meta, structure, performance, routing, images, accessibility')}",
)
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frame(spark, SITES, "site string, meta int, structure int, performance int, routing int, images int, accessibility int")
    return rows.select("site", A.health(*(F.col(c) for c in A.HEALTH)).alias("score"))


INPUTS = [("a.tsx", "input", "name", None), ("a.tsx", "label", None, "name"), ("a.tsx", "input", "mail", None), ("b.tsx", "label", None, "mail"), ("b.tsx", "select", "x", None)]


@query(
    "unlabelled_inputs",
    f"""WITH e AS (SELECT * FROM {values(INPUTS, 'file, tag, id, target')}) SELECT file, tag, id FROM e WHERE tag IN ('input', 'select') AND NOT EXISTS (SELECT 1 FROM e l WHERE l.tag = 'label' AND l.file = e.file AND l.target = e.id)""",
)
def unlabelled_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _frame(spark, INPUTS, "file string, tag string, id string, target string")
    labels = e.where("tag = 'label'").select("file", F.col("target").alias("id"))
    return e.where("tag in ('input', 'select')").join(labels, ["file", "id"], "left_anti").select("file", "tag", "id")


LINKS = [("/users/5",), ("/users/7/",), ("/about.html",), ("/nowhere",), ("/docs/index",), ("/users/5/posts/9?x=1",)]
TARGETS = [("/users/:id",), ("/about",), ("/docs",), ("/users/:id/posts/:post",), ("/hidden",)]


@query(
    "links_to_routes",
    f"""WITH l AS (SELECT href, regexp_replace(regexp_replace(regexp_replace(regexp_replace(href, '[?#].*$', ''), '\\.(html?|jsx?|tsx?)$', ''), '/index$', ''), '(.)/+$', '\\1') AS x FROM {values(LINKS, 'href')}),
    a AS (SELECT href, regexp_replace(x, '/[0-9]+', '/:p', 'g') AS pattern FROM l), b AS (SELECT route, regexp_replace(route, '/:[^/]+', '/:p', 'g') AS pattern FROM {values(TARGETS, 'route')})
    SELECT href, route FROM a LEFT JOIN b USING (pattern)""",
)
def links_to_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _frame(spark, LINKS, "href string").withColumn("pattern", A.route_pattern(F.col("href")))
    routes = _frame(spark, TARGETS, "route string").withColumn("pattern", A.route_pattern(F.col("route")))
    return links.join(routes, "pattern", "left").select("href", "route")


@query(
    "top_violations",
    "SELECT event_type AS rule, count(*) AS n, floor(count(*) * 10000.0 / sum(count(*)) OVER () + 0.5) / 100 AS percent FROM events GROUP BY 1 ORDER BY n DESC, rule LIMIT 10",
)
def top_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent rules with their share; the window is over one row a rule."""
    from pyspark.sql import Window as W

    n = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", round_half_up(F.col("n") * 100 / F.sum("n").over(W.partitionBy()), 2)).orderBy(F.desc("n"), "rule").limit(10)


@query(
    "files_with_most_keys",
    "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
)
def files_with_most_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds")).orderBy(F.desc("n"), "user_id").limit(10)


@query("largest_group", "SELECT max_by(source, (n, -first)) AS source, max(n) AS n FROM (SELECT source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1)")
def largest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest group, the first seen of equals."""
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return n.agg(F.max_by("source", F.struct("n", (-F.col("first")).alias("f"))).alias("source"), F.max("n").alias("n"))
