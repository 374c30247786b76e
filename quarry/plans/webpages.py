"""Pages in source form, over a small project's syntax nodes, literal facts and the given pages, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import audits as A
from quarry.operators import code as C
from quarry.operators import webpages as W
from quarry.plans.common import named, node_table, table, values
from quarry.registry import query
from quarry.sources import syntax

SOURCES = [
    ("src/app/page.tsx", 'export default function Page() {\n  return <main><img src="a.png" /><Image src="/b.webp" alt="shop" width="2" height="3" placeholder="blur" sizes="1" priority={true} />\n<iframe src="x" /><label htmlFor="mail">Mail</label><input id="mail" type="text" /><input id="other" aria-label="" />\n<button></button><div role="button">x</div>\n<label>Name<input name="n" placeholder="n" /></label><fieldset><p>x</p></fieldset><fieldset><legend>l</legend></fieldset>\n<div style={{ backgroundImage: "url(\'c.jpg\')" }} /><a href="/x">click here</a><select id="s" /></main>;\n}\n'),
    ("src/app/layout.tsx", 'export default function Layout({ children }) {\n  return <html lang="en"><head><link rel="stylesheet" href="https://fonts.googleapis.com/css" /><link rel="preload" href="/a.css" /><link rel="stylesheet" href="/a.css" /><script src="/b.js" /><script src="/c.js" async /></head><body>{children}</body></html>;\n}\n'),
    ("src/ui/Good.tsx", 'export const Good = () => <section><h1>ok</h1><img src="/d.svg" alt="d" width="1" height="1" loading="lazy" /></section>;\n'),
]
_LINES = [(p, c.count("\n") + 1) for p, c in SOURCES]


def _elements(spark: SparkSession) -> DataFrame:
    return C.elements(syntax.nodes(spark.createDataFrame(SOURCES, "path string, content string")))


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LINES, "path string, n_lines int")


_E = f"{node_table(SOURCES)}, e AS (SELECT path, node_id, exit, name AS tag, line FROM n WHERE kind = 'JsxElement'), a AS (SELECT path, parent_id AS node_id, name, coalesce(text, 'true') AS v FROM n WHERE kind = 'JsxAttribute'), f AS (SELECT * FROM {values(_LINES, 'path, n_lines')})"


def _v(name: str) -> str:
    return f"(SELECT max(a.v) FROM a WHERE a.path = e.path AND a.node_id = e.node_id AND a.name = '{name}')"


def _g(name: str) -> str:
    return f"coalesce({_v(name)}, '') <> ''"


_FORMAT = "CASE lower(regexp_extract(src, '\\.([A-Za-z]+)(?:[?#].*)?$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.FORMATS.items()) + " END"
_IMAGES = f"""{_E}, i AS (SELECT path, line, tag, coalesce({_v('src')}, '') AS src, {_v('alt')} AS alt, {_g('width')} AND {_g('height')} AS sized, {_g('width')} AS wide, {_g('sizes')} AS sizes, {_g('fill')} AS fill, {_g('placeholder')} AS placeholder, coalesce({_v('priority')} IN ('true', '{{true}}'), false) AS priority FROM e WHERE tag IN ('img', 'Image')),
    j AS (SELECT *, {_FORMAT} AS format FROM i), k AS (SELECT *, list_filter([CASE WHEN alt IS NULL THEN 'missing-alt:high' END, CASE WHEN tag = 'img' AND NOT sized THEN 'missing-dimensions:medium' END, CASE WHEN tag = 'img' AND src <> '' AND NOT starts_with(src, 'data:') THEN 'no-optimization:high' END, CASE WHEN tag = 'Image' AND NOT sizes AND NOT fill AND NOT wide THEN 'missing-sizes:medium' END,
      CASE WHEN tag = 'Image' AND NOT priority THEN 'no-priority:low' END, CASE WHEN format IN ('PNG', 'JPEG', 'GIF') THEN 'large-format:medium' END, CASE WHEN format IN ('PNG', 'JPEG') THEN 'wrong-format:medium' END], lambda x: x IS NOT NULL) AS issues FROM j),
    im AS (SELECT path, line, src, CASE tag WHEN 'Image' THEN 'next/image' ELSE 'img' END AS kind, format, array_to_string(issues, ',') AS issues, greatest(0, least(100, 100 - 25 * len(list_filter(issues, lambda x: ends_with(x, ':high'))) - 15 * len(list_filter(issues, lambda x: ends_with(x, ':medium'))) - 5 * len(list_filter(issues, lambda x: ends_with(x, ':low')))
      + CASE WHEN tag = 'Image' THEN 10 ELSE 0 END + CASE WHEN coalesce(alt, '') <> '' THEN 10 ELSE 0 END + CASE WHEN sized THEN 10 ELSE 0 END + CASE WHEN placeholder THEN 5 ELSE 0 END))::INT AS score FROM k UNION ALL SELECT path, line, regexp_extract({_v('style')}, 'url\\([''"]?([^''")]+)[''"]?\\)', 1), 'background-image', 'JPEG', 'no-optimization:medium', 30 FROM e WHERE contains({_v('style')}, 'background'))"""


@query("image_facts", f"WITH {_IMAGES} SELECT * FROM im")
def image_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of sources with issues and scores."""
    return W.images(_elements(spark)).withColumn("issues", F.array_join("issues", ",")).withColumn("score", F.col("score").cast("int"))


@query("image_statistics", f"WITH {_IMAGES} SELECT format, count(*) AS n, floor(avg(score) + 0.5)::BIGINT AS average, count_if(issues <> '') AS with_issues FROM im GROUP BY 1")
def image_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.image_statistics(W.images(_elements(spark)))


_ABOVE = "e.line <= greatest(1.0, f.n_lines * 0.2)"
_VITALS = f"""{_E}, v AS (SELECT e.path, e.line, 'CLS' AS vital, 'medium' AS severity, tag FROM e WHERE tag = 'img' AND NOT ({_g('width')} AND {_g('height')}) UNION ALL SELECT e.path, e.line, 'LCP', 'high', tag FROM e JOIN f USING (path) WHERE tag = 'img' AND {_g('src')} AND NOT {_g('priority')} AND {_ABOVE}
    UNION ALL SELECT e.path, e.line, 'LCP', 'high', tag FROM e JOIN f USING (path) WHERE tag = 'Image' AND NOT {_g('priority')} AND {_ABOVE} UNION ALL SELECT e.path, e.line, 'LCP', 'medium', tag FROM e WHERE tag = 'Image' AND NOT {_g('sizes')} UNION ALL SELECT e.path, e.line, 'CLS', 'high', tag FROM e WHERE tag IN ('iframe', 'embed', 'object') AND NOT ({_g('width')} AND {_g('height')})
    UNION ALL SELECT e.path, e.line, 'LCP', 'medium', tag FROM e WHERE tag = 'link' AND {_v('rel')} = 'stylesheet' AND contains({_v('href')}, 'fonts.googleapis.com'))"""


@query("web_vitals", f"WITH {_VITALS} SELECT * FROM v")
def web_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.vitals(_elements(spark), _files(spark))


@query("web_vital_statistics", f"WITH {_VITALS} SELECT vital, count(*) AS n, count(DISTINCT path) AS pages, count_if(severity = 'high') AS high FROM v GROUP BY 1")
def web_vital_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.vital_statistics(W.vitals(_elements(spark), _files(spark)))


@query("lazy_images", f"WITH {_E} SELECT e.path, e.line, coalesce({_v('src')}, '') AS src, coalesce({_v('loading')}, '') = 'lazy' OR (tag = 'Image' AND NOT {_g('priority')}) AS lazy, {_ABOVE} AS first FROM e JOIN f USING (path) WHERE tag IN ('img', 'Image')")
def lazy_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.lazy_images(_elements(spark), _files(spark))


PARTS = [("a.tsx", "A", 300), ("b.tsx", "B", 20), ("c.tsx", "C", 20), ("d.tsx", "D", 500)]


@query("lazy_components", f"WITH {named('c', PARTS, 'path, name, n_lines')} SELECT path, name, path = 'd.tsx' AS is_lazy, (n_lines > 200 OR path = 'b.tsx') AND path <> 'd.tsx' AS should_be_lazy, CASE path WHEN 'a.tsx' THEN 2 ELSE 0 END AS n_pages FROM c")
def lazy_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.createDataFrame
    found = W.lazy_loading(frame(PARTS, "path string, name string, n_lines int"), frame([("d.tsx",)], "path string"), frame([("b.tsx", "large"), ("c.tsx", "small")], "path string, size string"), frame([("a.tsx", "A", 2)], "path string, name string, n_pages int"))
    return found


IMPORTS = [("a.tsx", "lodash", False, True, False), ("b.tsx", "lodash", False, True, False), ("a.tsx", "react", False, True, False), ("a.tsx", "three/core", True, False, False), ("a.tsx", "yup", False, False, True), ("a.tsx", "unknown-lib", False, False, False), ("a.tsx", "./x", False, True, False), ("a.tsx", "@mui/material/Button", False, True, False)]
_SIZE = f"CASE WHEN name IN ({', '.join(repr(x) for x in W.SMALL)}) OR regexp_matches(specifier, '^(\\.|/|@/)') THEN 'small' WHEN name IN ({', '.join(repr(x) for x in W.LARGE)}) THEN 'large' ELSE 'medium' END"
_HEAVY = f"""{named("i", IMPORTS, "path, specifier, dynamic, is_page, is_server")}, s AS (SELECT *, CASE WHEN starts_with(specifier, '@') THEN array_to_string(string_split(specifier, '/')[1:2], '/') ELSE split_part(specifier, '/', 1) END AS name FROM i),
    h AS (SELECT specifier, {_SIZE} AS size, count(DISTINCT path) AS n_files, count(DISTINCT CASE WHEN is_page THEN path END) AS pages, bool_and(dynamic) AS dynamic, bool_and(is_server) AS server, bool_or(specifier IN ('lodash', 'date-fns', 'ramda', 'rxjs')) AS whole FROM s GROUP BY specifier, name),
    p AS (SELECT *, CASE size WHEN 'large' THEN 3 WHEN 'medium' THEN 1 ELSE 0 END + pages * 2 + CASE WHEN server THEN 0 ELSE 2 END + CASE WHEN NOT dynamic AND pages > 0 THEN 3 ELSE 0 END + CASE WHEN whole THEN 2 ELSE 0 END - CASE WHEN dynamic THEN 1 ELSE 0 END AS points FROM h)"""


@query("heavy_imports", f"WITH {_HEAVY} SELECT specifier, size, n_files, pages, dynamic, server, whole, CASE WHEN points >= 6 THEN 'high' WHEN points >= 3 THEN 'medium' ELSE 'low' END AS impact, whole OR (size = 'large' AND pages > 0) OR (size <> 'small' AND NOT dynamic AND (NOT server OR pages > 3)) AS flagged FROM p")
def heavy_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From imports to size, impact and verdict."""
    return W.heavy_imports(spark.createDataFrame(IMPORTS, "path string, specifier string, dynamic boolean, is_page boolean, is_server boolean"))


@query(
    "critical_resources",
    f"""WITH {_E}, r AS (SELECT e.path, e.node_id, e.line, CASE WHEN tag = 'link' AND {_v('rel')} = 'stylesheet' THEN 'style' WHEN tag IN ('script', 'Script') THEN 'script' WHEN tag = 'link' AND regexp_matches({_v('href')}, '\\.woff2?$') THEN 'font' END AS kind, coalesce({_v('href')}, {_v('src')}, '') AS address, {_v('async')} IS NOT NULL OR {_v('defer')} IS NOT NULL AS later FROM e)
    SELECT path, line, kind, address, EXISTS (SELECT 1 FROM e JOIN a h ON h.path = e.path AND h.node_id = e.node_id AND h.name = 'href' JOIN a l ON l.path = e.path AND l.node_id = e.node_id AND l.name = 'rel' AND l.v = 'preload' WHERE e.path = r.path AND h.v = r.address) AS preloaded, kind IN ('style', 'script') AND NOT later AS blocks FROM r WHERE kind IS NOT NULL AND address <> ''""",
)
def critical_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.critical_resources(_elements(spark))


#: Counts by reading the sources.
COUNTERS = [("src/app/page.tsx", 1, 1, 0, 1, 1, 2, 1, 3, 1), ("src/app/layout.tsx", 0, 0, 0, 0, 0, 0, 0, 0, 0), ("src/ui/Good.tsx", 1, 0, 0, 0, 0, 0, 0, 0, 0)]


@query("page_counters", f"WITH {named('c', COUNTERS, 'path, images, missing_alt, decorative, aria, misused_aria, buttons, buttons_without_text, inputs, unlabelled')} SELECT * FROM c")
def page_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.page_counters(_elements(spark))


#: Violations by reading the sources, and what they cost.
SCORES = [("src/app/page.tsx", 18, 7, 11, "none"), ("src/app/layout.tsx", 8, 0, 100, "AAA"), ("src/ui/Good.tsx", 3, 0, 100, "AAA")]


@query("accessibility_scores", f"WITH {named('s', SCORES, 'path, elements, violations, score, level')} SELECT * FROM s")
def accessibility_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _elements(spark)
    return C.accessibility_scores(found, C.accessibility_violations(found))


LD = [
    (1, '<script type="application/ld+json">{"@context": "https://schema.org", "@type": "Product", "name": "x", "brand": "y"}</script>'), (2, '<script type="application/ld+json">{"@graph": [{"@type": "Article", "headline": "h"}, {"@type": "Event"}]}</script><script type="application/ld+json">broken</script>'),
    (3, '<script type="application/ld+json">[{"@context": "c", "@type": "Product"}]</script>'), (4, "<p>none</p>"),
]
#: The blocks as rows: page, type, properties.
BLOCKS = [(1, "Product", "@context @type brand name"), (2, "Article", "@type headline"), (2, "Event", "@type"), (3, "Product", "@context @type")]


def _share(names: list[str]) -> str:
    return f"len(list_intersect(string_split(props, ' '), [{', '.join(repr(n) for n in names)}]))::DOUBLE / {len(names)}"


_COVER = "CASE type " + " ".join(f"WHEN '{k}' THEN floor(100 * (0.7 * ({_share(a)}) + 0.3 * ({_share(b)})) + 0.5)::BIGINT" for k, (a, b) in A.SCHEMAS.items()) + f" ELSE floor(100 * (0.7 * ({_share(['@context', '@type'])}) + 0.3 * ({_share(['name', 'description', 'url', 'image'])})) + 0.5)::BIGINT END"
_LACKS = "CASE type " + " ".join(f"WHEN '{k}' THEN list_filter([{', '.join(repr(n) for n in a)}], lambda x: NOT list_contains(string_split(props, ' '), x))" for k, (a, _) in A.SCHEMAS.items()) + " ELSE list_filter(['@context', '@type'], lambda x: NOT list_contains(string_split(props, ' '), x)) END"


@query("structured_data", f"WITH {named('b', BLOCKS, 'page_id, type, props')} SELECT page_id, type, props AS properties, {_COVER} AS coverage, array_to_string({_LACKS}, ',') AS missing FROM b")
def structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD of pages, with coverage and what is missing."""
    found = W.structured_data(spark.createDataFrame(LD, "page_id long, html string"))
    return found.select("page_id", "type", F.array_join("properties", " ").alias("properties"), "coverage", F.array_join("missing", ",").alias("missing"))


@query("structured_data_statistics", f"WITH {named('b', BLOCKS, 'page_id, type, props')} SELECT count(*) AS blocks, count(DISTINCT page_id) AS pages, floor(count(*) / count(DISTINCT page_id) * 100 + 0.5) / 100 AS per_page, 'Product:2' AS common FROM b")
def structured_data_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.schema_statistics(W.structured_data(spark.createDataFrame(LD, "page_id long, html string"))).withColumn("common", F.array_join("common", ","))


@query("page_titles_and_language", "SELECT page_id, 'title' AS tag, regexp_matches(html, '(?is)<title[^>]*>.+?</title>') AS present, coalesce(length(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))), 0) AS length FROM pages")
def page_titles_and_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles among the meta tags of all pages."""
    return W.meta_tags(table(spark, sf_dir, "pages")).where("tag = 'title'")


META = [(1, '<title> Shop </title><meta name="description" content="All we sell"><meta property="og:title" content="T"><link rel="canonical" href="/x"><meta content="width=1" name="viewport">'), (2, "<title></title><meta name='robots' content='noindex'>")]
FOUND = {(1, "title"): 4, (1, "description"): 11, (1, "og:title"): 1, (1, "canonical"): 2, (1, "viewport"): 7, (2, "robots"): 7}


@query("meta_tags", f"WITH {named('m', [(p, t, (p, t) in FOUND, FOUND.get((p, t), 0)) for p in (1, 2) for t in W.META], 'page_id, tag, present, length')} SELECT * FROM m")
def meta_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen tags of pages, their presence and length; the SQL holds what reading gives."""
    return W.meta_tags(spark.createDataFrame(META, "page_id long, html string"))


LAYOUTS = [("app/layout.tsx", "title"), ("app/layout.tsx", "robots"), ("app/shop/layout.tsx", "title"), ("app/shop/a/layout.tsx", "title"), ("app/shop/a/layout.tsx", "icons")]


@query("layout_conflicts", f"WITH {named('l', LAYOUTS, 'path, field')}, d AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir FROM l) SELECT a.path, a.field, arg_max(b.path, length(b.dir)) AS above FROM d a JOIN d b ON a.field = b.field AND a.dir <> b.dir AND starts_with(a.dir, b.dir || '/') GROUP BY 1, 2")
def layout_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.layout_conflicts(spark.createDataFrame(LAYOUTS, "path string, field string"))


SPECIAL = [("app/error.tsx", "export default function E() {}"), ("app/shop/error.tsx", "'use client';\nexport default function E({ reset }) {}"), ("app/layout.tsx", "export default function L() {}"), ("app/loading.tsx", "export default async function L() { await f(); }"), ("app/page.tsx", "export const x = 1;"), ("lib/error.tsx", "x"), ("app/global-error.tsx", "'use client';\nexport default function G({ reset }) { return <p/>; }")]
ISSUES = [("app/error.tsx", "error-not-client"), ("app/error.tsx", "error-without-reset"), ("app/layout.tsx", "layout-without-children"), ("app/loading.tsx", "loading-waits"), ("app/page.tsx", "no-default-export"), ("app/global-error.tsx", "global-error-without-html")]


@query("special_file_issues", f"WITH {named('i', ISSUES, 'path, issue')} SELECT * FROM i")
def special_file_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.special_file_issues(spark.createDataFrame(SPECIAL, "path string, content string"))


PATHS = [("app/(shop)/cart/page.tsx",), ("app/(shop)/layout.tsx",), ("app/@modal/(.)photo/[id]/page.tsx",), ("app/docs/[...slug]/page.tsx",), ("app/docs/error.tsx",), ("app/docs/loading.tsx",), ("app/page.tsx",), ("app/layout.tsx",), ("app/error.tsx",), ("app/not-found.tsx",)]
_SEG = "list_filter(string_split(regexp_extract(path, 'app/(.*)$', 1), '/'), lambda s: regexp_matches(s, '{0}'))"


@query(
    "router_facts",
    f"""WITH {named("p", PATHS, "path")}, d AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem FROM p), r AS (SELECT dir, sum(CASE stem WHEN 'layout' THEN 30 WHEN 'error' THEN 30 WHEN 'loading' THEN 20 WHEN 'not-found' THEN 20 ELSE 0 END)::BIGINT AS readiness FROM d GROUP BY 1)
    SELECT path, array_to_string({_SEG.format('^\\([^.].*\\)$')}, ',') AS groups, array_to_string({_SEG.format('^@')}, ',') AS slots, array_to_string({_SEG.format('^\\(\\.+\\)')}, ',') AS intercepts, len({_SEG.format('^\\[[^.\\]]+\\]$')}) > 0 AS dynamic, len({_SEG.format('^\\[\\[?\\.\\.\\.')}) > 0 AS catch_all, readiness FROM d JOIN r USING (dir)""",
)
def router_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = W.router_facts(spark.createDataFrame(PATHS, "path string"))
    return r.select("path", *(F.array_join(c, ",").alias(c) for c in ("groups", "slots", "intercepts")), "dynamic", "catch_all", "readiness")


@query("route_map", f"WITH {named('r', [('/cart', 'app/(shop)/cart/page.tsx'), ('/docs/*', 'app/docs/[...slug]/page.tsx'), ('/', 'app/page.tsx'), ('/(.)photo/:id', 'app/@modal/(.)photo/[id]/page.tsx')], 'route, path')} SELECT * FROM r")
def route_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.route_map(spark.createDataFrame(PATHS, "path string"))


SITES = [("one", 1, 0, 2, 0, 0, 0), ("two", 0, 0, 0, 0, 0, 0)]


@query("site_suggestions", f"WITH {named('s', SITES, 'site, meta, structure, performance, routing, images, accessibility')} SELECT site, 'meta' AS area, meta AS n, meta || ' findings on meta.' AS text FROM s WHERE meta > 0 UNION ALL SELECT site, 'performance', performance, performance || ' findings on performance.' FROM s WHERE performance > 0")
def site_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.suggestions(spark.createDataFrame(SITES, "site string, meta int, structure int, performance int, routing int, images int, accessibility int"))


ADVICE = [("/a", 40.0, True, False, True, True), ("/b", 100.0, True, True, True, False), ("/c", 60.0, False, True, False, False)]


@query("coverage_advice", f"WITH {named('a', [('/a', 'add an error file: the route takes parameters'), ('/a', 'cover the route: less than half of the files are there'), ('/c', 'add a layout'), ('/c', 'add a loading file')], 'route, advice')} SELECT * FROM a")
def coverage_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.coverage_advice(spark.createDataFrame(ADVICE, "route string, coverage double, layout boolean, error boolean, loading boolean, dynamic boolean"))
