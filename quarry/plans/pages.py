"""Audits of web pages: headings, landmarks, titles, links, language, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.text import round_half_up
from quarry.operators import code as C
from quarry.operators import webpages as WP
from quarry.plans.common import table, values
from quarry.registry import query
from quarry.sources import pages as H
from quarry.sources.markup import attribute_pattern

LEVELS = range(1, 7)
_COUNTS = ", ".join(f"len(regexp_extract_all(html, '<h{i}[\\s>/]')) AS h{i}" for i in LEVELS)
_HEADINGS = f"SELECT page_id, {_COUNTS} FROM pages"
_PATH = r"CASE WHEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
_FOUND = f"""SELECT page_id, url, unnest(regexp_extract_all(regexp_replace(html, '{H.HIDDEN}', '', 'g'), '{H.LINK.replace("'", "''")}')) AS m FROM pages"""
_VALUE = f"regexp_extract(m, '{attribute_pattern('href').replace(chr(39), chr(39) * 2)}', 1)"
_LINKS = f"""SELECT page_id, url, regexp_replace({_VALUE}, '^["'']|["'']$', '', 'g') AS href, trim(regexp_replace(regexp_replace(m, '{H.TAG.replace("'", "''")}', '', 'g'), '\\s+', ' ', 'g'), ' ') AS label FROM ({_FOUND}) WHERE {_VALUE} <> ''"""
_NORMAL = r"CASE WHEN x = '' THEN '/' ELSE x END"
_LINK_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(href, '[?#].*$', ''), '\.(html?|jsx?|tsx?)$', ''), '/index$', ''), '(.)/+$', '\1')"


#: Pages with what the given ones lack: two h1, none, a skipped level, no language, a malformed one, resources by http (fixture).
ODD_PAGES = [
    (1, '<html lang="en"><h1>a</h1><h1>b</h1><h2>c</h2><img src="http://x.org/a.png"><script src="https://x.org/a.js"></script></html>'), (2, '<html><h2>a</h2><h4>b</h4><iframe src="http://x.org/f"></iframe></html>'),
    (3, '<html lang="english!"><h1>a</h1><h2>b</h2><link rel="stylesheet" href="http://x.org/s.css"><a href="http://x.org">x</a></html>'), (4, '<html lang="de-AT"><h1>a</h1></html>'),
]
_ODD = f"(SELECT * FROM {values(ODD_PAGES, 'page_id, html')} UNION ALL SELECT page_id, html FROM pages)"


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages and the odd ones."""
    return spark.createDataFrame(ODD_PAGES, "page_id long, html string").union(table(spark, sf_dir, "pages").select("page_id", "html"))


def _headings(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    return (table(spark, sf_dir, "pages") if pages is None else pages).select("page_id", *(H.count_tag(F.col("html"), f"h{i}").alias(f"h{i}") for i in LEVELS))


def _skipped() -> F.Column:
    """Whether a level is used while the one above it isn't (level 1 counts as used)."""
    out = F.lit(False)
    for i in range(3, 7):
        out = out | ((F.col(f"h{i}") > 0) & (F.col(f"h{i - 1}") == 0))
    return out


_SKIPPED_SQL = " OR ".join(f"(h{i} > 0 AND h{i - 1} = 0)" for i in range(3, 7))


@query(
    "page_audit",
    rf"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html[^>]*\slang="([^"]*)"', 1) AS lang,
      len(regexp_extract_all(html, '<h1[\s>/]')) AS h1, len(regexp_extract_all(html, '<a[\s>/]')) AS n_links, length({_TEXT}) AS text_length, length(html) AS html_length FROM pages)
    SELECT page_id, title, lang, h1, n_links, text_length, floor(text_length * 10000.0 / html_length + 0.5) / 10000 AS text_ratio,
      (h1 = 1) AND (lang <> '') AND length(title) BETWEEN 30 AND 60 AS clean FROM p""",
)
def page_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    p = table(spark, sf_dir, "pages").select(
        "page_id", H.title(html).alias("title"), F.coalesce(H.language(html), F.lit("")).alias("lang"), H.count_tag(html, "h1").alias("h1"), H.count_tag(html, "a").alias("n_links"),
        F.length(H.visible_text(html)).alias("text_length"), F.length(html).alias("html_length"),
    )
    clean = (F.col("h1") == 1) & (F.col("lang") != "") & F.length("title").between(30, 60)
    return p.select("page_id", "title", "lang", "h1", "n_links", "text_length", round_half_up(F.col("text_length") / F.col("html_length"), 4).alias("text_ratio"), clean.alias("clean"))


@query(
    "heading_issues",
    f"""WITH h AS ({_HEADINGS.replace('FROM pages', 'FROM ' + _ODD)}) SELECT page_id, 'missing-h1' AS issue FROM h WHERE h1 = 0 UNION ALL SELECT page_id, 'multiple-h1' FROM h WHERE h1 > 1
    UNION ALL SELECT page_id, 'skipped-level' FROM h WHERE {_SKIPPED_SQL}""",
)
def heading_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = F.array_compact(F.array(F.when(F.col("h1") == 0, "missing-h1").when(F.col("h1") > 1, "multiple-h1"), F.when(_skipped(), "skipped-level")))
    return _headings(spark, sf_dir, _odd(spark, sf_dir)).select("page_id", F.explode(issues).alias("issue"))


@query(
    "heading_histogram",
    f"""WITH h AS ({_HEADINGS}) SELECT {", ".join(f"sum(h{i})::BIGINT AS h{i}" for i in LEVELS)}, count_if(h1 > 0) AS pages_with_h1,
    floor(sum(h1 + h2 + h3 + h4 + h5 + h6) * 100.0 / greatest(count(*), 1) + 0.5) / 100 AS average_headings FROM h""",
)
def heading_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = sum((F.col(f"h{i}") for i in LEVELS), F.lit(0))
    average = round_half_up(F.sum(every) / F.greatest(F.count(F.lit(1)), F.lit(1)), 2)
    return _headings(spark, sf_dir).agg(*(F.sum(f"h{i}").alias(f"h{i}") for i in LEVELS), F.count_if(F.col("h1") > 0).alias("pages_with_h1"), average.alias("average_headings"))


@query(
    "landmark_coverage",
    " UNION ALL ".join(
        f"SELECT '{t}' AS landmark, sum(len(regexp_extract_all(html, '<{t}[\\s>/]')))::BIGINT AS total, count_if(regexp_matches(html, '<{t}[\\s>/]')) AS pages FROM pages" for t in H.LANDMARKS
    ),
)
def landmark_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.array(*(F.struct(F.lit(t).alias("landmark"), H.count_tag(F.col("html"), t).alias("n")) for t in H.LANDMARKS))
    rows = table(spark, sf_dir, "pages").select(F.explode(counts).alias("x")).select("x.*")
    return rows.groupBy("landmark").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("pages"))


@query(
    "text_markup_ratio",
    f"""SELECT count(*) AS n_pages, sum(length({_TEXT}))::BIGINT AS text_length, sum(length(html))::BIGINT AS html_length, sum(len(regexp_extract_all(html, '<p[\\s>/]')))::BIGINT AS paragraphs,
    sum(len(regexp_extract_all(html, '<(ul|ol)[\\s>/]')))::BIGINT AS lists FROM pages""",
)
def text_markup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum(F.length(H.visible_text(html))).alias("text_length"), F.sum(F.length(html)).alias("html_length"),
        F.sum(H.count_tag(html, "p")).alias("paragraphs"), F.sum(H.count_tag(html, "(ul|ol)")).alias("lists"),
    )


def _internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = H.links(table(spark, sf_dir, "pages"))
    return every.where(F.col("href").startswith("/")).select("page_id", P.normal_link(F.col("href")).alias("target"), "label")


@query("internal_links", f"SELECT page_id, {_NORMAL} AS target, count(*) AS n FROM (SELECT page_id, {_LINK_NORMAL} AS x FROM ({_LINKS}) WHERE href LIKE '/%') GROUP BY 1, 2")
def internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _internal(spark, sf_dir).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


@query(
    "orphan_pages",
    f"""WITH t AS (SELECT DISTINCT {_NORMAL} AS target FROM (SELECT {_LINK_NORMAL} AS x FROM ({_LINKS}) WHERE href LIKE '/%')), p AS (SELECT page_id, {_PATH} AS path FROM pages)
    SELECT page_id, path FROM p WHERE path NOT IN ('/', '/index') AND NOT EXISTS (SELECT 1 FROM t WHERE t.target = p.path)""",
)
def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", P.url_path(F.col("url")).alias("path")).where(~F.col("path").isin("/", "/index"))
    targets = _internal(spark, sf_dir).select(F.col("target").alias("path")).distinct()
    return pages.join(targets, "path", "left_anti").select("page_id", "path")


@query(
    "average_links",
    f"""WITH l AS (SELECT page_id FROM ({_LINKS}) WHERE href LIKE '/%') SELECT count(*) AS links, count(DISTINCT page_id) AS pages, floor(count(*) * 100.0 / count(DISTINCT page_id) + 0.5) / 100 AS average FROM l""",
)
def average_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_page = _internal(spark, sf_dir).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return per_page.agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("pages"), round_half_up(F.try_divide(F.sum("n"), F.count(F.lit(1))), 2).alias("average"))


@query(
    "duplicate_titles",
    "SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1 HAVING count(*) > 1 AND regexp_extract(any_value(html), '<title>([^<]*)</title>', 1) <> ''",
)
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title")).where("title <> ''")
    return titles.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


@query(
    "duplicate_titles_by_length",
    "SELECT length(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title_length, count(*) AS n, min(page_id) AS first_page FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_titles_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped by the title's length, as the report that users know has it."""
    titles = table(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title")).where("title <> ''")
    return titles.groupBy(F.length("title").alias("title_length")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


@query(
    "meta_tag_statistics",
    """WITH p AS (SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<meta\\s+(?:name|property)="description"\\s+content="([^"]*)"', 1) AS description,
      regexp_matches(html, '<link[^>]*rel="canonical"') AS canonical, regexp_matches(html, '<meta\\s+(?:name|property)="(og|twitter):') AS social, regexp_matches(html, '<meta[^>]*name="viewport"') AS viewport FROM pages)
    SELECT count(*) AS pages, count_if(title <> '') AS with_title, count_if(description <> '') AS with_description, count_if(canonical) AS with_canonical, count_if(social) AS with_social, count_if(viewport) AS with_viewport,
      floor(sum(length(title)) * 100.0 / count(*) + 0.5) / 100 AS average_title_length FROM p""",
)
def meta_tag_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    html, one = F.col("html"), F.count(F.lit(1))
    title = H.title(html)
    return table(spark, sf_dir, "pages").agg(
        one.alias("pages"), F.count_if(title != "").alias("with_title"), F.count_if(H.meta(html, "description") != "").alias("with_description"),
        F.count_if(html.rlike(r'<link[^>]*rel="canonical"')).alias("with_canonical"), F.count_if(html.rlike(r'<meta\s+(?:name|property)="(og|twitter):')).alias("with_social"),
        F.count_if(html.rlike(r'<meta[^>]*name="viewport"')).alias("with_viewport"), round_half_up(F.try_divide(F.sum(F.length(title)), one), 2).alias("average_title_length"),
    )


@query(
    "html_lang_rule",
    rf"""SELECT page_id, CASE WHEN NOT regexp_matches(html, '<html[^>]*\slang="') THEN 'missing' WHEN NOT regexp_matches(regexp_extract(html, '<html[^>]*\slang="([^"]*)"', 1), '^[a-z]{{2,3}}(-[A-Za-z0-9]+)*$') THEN 'malformed' END AS problem,
    CASE WHEN NOT regexp_matches(html, '<html[^>]*\slang="') THEN 'error' ELSE 'warning' END AS severity FROM {_ODD}
    WHERE NOT regexp_matches(html, '<html[^>]*\slang="') OR NOT regexp_matches(regexp_extract(html, '<html[^>]*\slang="([^"]*)"', 1), '^[a-z]{{2,3}}(-[A-Za-z0-9]+)*$')""",
)
def html_lang_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = H.language(F.col("html"))
    problem = F.when(lang.isNull(), "missing").when(~lang.rlike(r"^[a-z]{2,3}(-[A-Za-z0-9]+)*$"), "malformed")
    return _odd(spark, sf_dir).select("page_id", problem.alias("problem"), F.when(lang.isNull(), "error").otherwise("warning").alias("severity")).where("problem is not null")


#: Link texts that say nothing (fixed values).
VAGUE = ("click here", "read more", "learn more", "here", "more", "link", "this")


@query(
    "link_text_rule",
    f"""SELECT page_id, href, CASE WHEN trim(label) = '' THEN 'empty' ELSE 'not-descriptive' END AS problem, count(*) AS n FROM ({_LINKS})
    WHERE trim(label) = '' OR lower(trim(label)) IN ({", ".join(f"'{x}'" for x in VAGUE)}) OR length(trim(label)) < 3 GROUP BY ALL""",
)
def link_text_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.btrim("label")
    bad = H.links(table(spark, sf_dir, "pages")).where((label == "") | F.lower(label).isin(*VAGUE) | (F.length(label) < 3))
    return bad.groupBy("page_id", "href", F.when(label == "", "empty").otherwise("not-descriptive").alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "mixed_content_findings",
    rf"""SELECT page_id, lower(regexp_extract(m, '^<(\w+)', 1)) AS tag, regexp_extract(m, '=["''](http://[^"'']+)["'']$', 1) AS address
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:img|script|iframe|audio|video|source|embed|link|object)\b[^>]*?(?:src|href|data)=["'']http://[^"'']+["'']')) AS m FROM {_ODD})""",
)
def mixed_content_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources that a page loads by http, over all pages."""
    return WP.mixed_content(_odd(spark, sf_dir))


@query(
    "route_from_url",
    rf"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), s AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM p)
    SELECT page_id, path, len(seg) AS depth, '/' || array_to_string(list_transform(seg, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN ':id' ELSE x END), '/') AS route,
      len(list_filter(seg, lambda x: regexp_matches(x, '^[0-9]+$'))) > 0 AS is_dynamic FROM s""",
)
def route_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", P.url_path(F.col("url")).alias("path"))
    seg = P.segments(F.col("path"))
    route = F.concat(F.lit("/"), F.array_join(F.transform(seg, lambda s: F.when(s.rlike("^[0-9]+$"), ":id").otherwise(s)), "/"))
    return pages.select("page_id", "path", F.size(seg).alias("depth"), route.alias("route"), F.exists(seg, lambda s: s.rlike("^[0-9]+$")).alias("is_dynamic"))


@query(
    "route_depths",
    rf"""WITH p AS (SELECT {_PATH} AS path FROM pages), s AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM p)
    SELECT len(seg) AS depth, count(*) AS pages, count_if(len(list_filter(seg, lambda x: regexp_matches(x, '^[0-9]+$'))) > 0) AS dynamic FROM s GROUP BY 1""",
)
def route_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = route_from_url(spark, sf_dir)
    return r.groupBy("depth").agg(F.count(F.lit(1)).alias("pages"), F.count_if("is_dynamic").alias("dynamic"))


#: Files of a routed application: path (fixture).
ROUTE_FILES = [
    ("app/page.tsx",), ("app/layout.tsx",), ("app/error.tsx",), ("app/(shop)/items/page.tsx",), ("app/(shop)/items/[id]/page.tsx",), ("app/(shop)/items/loading.tsx",),
    ("app/docs/[...slug]/page.tsx",), ("app/docs/layout.tsx",), ("app/@side/panel/page.js",), ("app/opt/[[...rest]]/page.tsx",), ("src/pages/index.tsx",), ("src/pages/users/[id].tsx",),
]
_IN = r"regexp_replace(regexp_replace(regexp_extract(path, '(?:^|/)(?:app|pages)/(.*)$', 1), '(^|/)(page|index|route)\.[jt]sx?$', ''), '\.[jt]sx?$', '')"
_NAMED = r"""list_transform(list_filter(string_split(inside, '/'), lambda s: s <> '' AND NOT regexp_matches(s, '^\(.*\)$') AND NOT starts_with(s, '@')), lambda s: CASE WHEN regexp_matches(s, '^\[\[?\.\.\.[^\]]*\]\]?$') THEN '*' ELSE regexp_replace(s, '^\[([^\]]*)\]$', ':\1') END)"""


@query(
    "route_of_file",
    rf"""WITH f AS (SELECT path, {_IN} AS inside FROM {values(ROUTE_FILES, "path")} WHERE regexp_matches(path, '(/page\.[jt]sx?|pages/.*)$')), r AS (SELECT path, {_NAMED} AS parts FROM f)
    SELECT path, '/' || array_to_string(parts, '/') AS route, len(list_filter(parts, lambda s: starts_with(s, ':') OR s = '*')) > 0 AS is_dynamic, list_contains(parts, '*') AS is_catch_all, len(parts) AS depth FROM r""",
)
def route_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame(ROUTE_FILES, "path string").where(F.col("path").rlike(r"(/page\.[jt]sx?|pages/.*)$"))
    parts = P.segments(F.col("route"))
    return files.withColumn("route", P.route_of_file(F.col("path"))).select(
        "path", "route", F.exists(parts, lambda s: s.startswith(":") | (s == "*")).alias("is_dynamic"), F.array_contains(parts, "*").alias("is_catch_all"), F.size(parts).alias("depth")
    )


#: Elements of a file: file, elem_id, tag, id, alt, text (fixture).
ELEMENTS = [
    ("a.tsx", 1, "h2", None, None, "Start"), ("a.tsx", 2, "h4", "x", None, "Skip"), ("a.tsx", 3, "img", None, None, ""), ("a.tsx", 4, "img", "x", "", ""), ("a.tsx", 5, "img", None, "image", ""),
    ("b.tsx", 1, "h1", "x", None, "One"), ("b.tsx", 2, "h2", "y", None, "Two"), ("b.tsx", 3, "h3", "y", None, "Three"), ("b.tsx", 4, "h5", None, None, "Five"), ("b.tsx", 5, "img", None, "A red fox", ""),
    ("c.tsx", 1, "h1", None, None, "Only"), ("c.tsx", 2, "h2", None, None, "Two"), ("c.tsx", 3, "h1", None, None, "Again"),
]
_ELEMENTS = values(ELEMENTS, "file, elem_id, tag, id, alt, text")


def _elements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ELEMENTS, "file string, elem_id int, tag string, id string, alt string, text string")


@query(
    "heading_hierarchy_rule",
    f"""WITH h AS (SELECT file, elem_id, substr(tag, 2)::INT AS level, lag(substr(tag, 2)::INT) OVER (PARTITION BY file ORDER BY elem_id) AS previous FROM {_ELEMENTS} WHERE regexp_matches(tag, '^h[1-6]$'))
    SELECT file, elem_id, level, CASE WHEN previous IS NULL THEN 'heading-hierarchy-start' ELSE 'heading-hierarchy-skip' END AS rule FROM h WHERE (previous IS NULL AND level <> 1) OR level > previous + 1""",
)
def heading_hierarchy_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.substring("tag", 2, 1).cast("int")
    h = _elements(spark).where(F.col("tag").rlike("^h[1-6]$")).select("file", "elem_id", level.alias("level"))
    h = h.withColumn("previous", F.lag("level").over(W.partitionBy("file").orderBy("elem_id")))
    first = F.col("previous").isNull()
    bad = h.where((first & (F.col("level") != 1)) | (F.col("level") > F.col("previous") + 1))
    return bad.select("file", "elem_id", "level", F.when(first, "heading-hierarchy-start").otherwise("heading-hierarchy-skip").alias("rule"))


@query("duplicate_id_rule", f"SELECT file, id, elem_id FROM (SELECT *, count(*) OVER (PARTITION BY file, id) AS n FROM {_ELEMENTS} WHERE id IS NOT NULL) WHERE n > 1")
def duplicate_id_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _elements(spark).where("id is not null").withColumn("n", F.count(F.lit(1)).over(W.partitionBy("file", "id")))
    return own.where("n > 1").select("file", "id", "elem_id")


@query(
    "img_alt_rule",
    f"""SELECT file, elem_id, CASE WHEN alt IS NULL THEN 'img-alt' ELSE 'img-alt-meaningful' END AS rule, CASE WHEN alt IS NULL THEN 'error' ELSE 'warning' END AS severity FROM {_ELEMENTS}
    WHERE tag = 'img' AND (alt IS NULL OR lower(trim(alt)) IN ('image', 'picture', 'photo', 'icon', 'img'))""",
)
def img_alt_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.col("alt").isNull()
    vague = F.lower(F.btrim("alt")).isin("image", "picture", "photo", "icon", "img")
    bad = _elements(spark).where((F.col("tag") == "img") & (missing | vague))
    return bad.select("file", "elem_id", F.when(missing, "img-alt").otherwise("img-alt-meaningful").alias("rule"), F.when(missing, "error").otherwise("warning").alias("severity"))


@query(
    "accessibility_score",
    f"""WITH v AS (SELECT file, elem_id, CASE WHEN tag = 'img' AND alt IS NULL THEN 10 WHEN tag = 'img' AND lower(trim(alt)) IN ('image', 'picture', 'photo', 'icon', 'img') THEN 5 ELSE 0 END AS penalty FROM {_ELEMENTS})
    SELECT file, count(*) AS elements, count_if(penalty > 0) AS violations, greatest(0, floor(100.0 * count_if(penalty = 0) / count(*) - least(2 * sum(penalty), 50) + 0.5))::BIGINT AS score,
      CASE WHEN max(penalty) >= 10 THEN 'none' ELSE 'AAA' END AS level FROM v GROUP BY file""",
)
def accessibility_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vague = F.lower(F.btrim("alt")).isin("image", "picture", "photo", "icon", "img")
    penalty = F.when(F.col("tag") == "img", F.when(F.col("alt").isNull(), 10).when(vague, 5).otherwise(0)).otherwise(0)
    p = _elements(spark).withColumn("penalty", penalty)
    score = F.greatest(F.lit(0), F.floor(100.0 * F.count_if(F.col("penalty") == 0) / F.count(F.lit(1)) - F.least(2 * F.sum("penalty"), F.lit(50)) + 0.5))
    # Both rules are of level A: a missing text is an error, a vague one a warning that no level counts.
    errors = F.count_if(F.col("penalty") >= 10)
    level = C.compliance(errors, errors, F.lit(0))
    return p.groupBy("file").agg(F.count(F.lit(1)).alias("elements"), F.count_if(F.col("penalty") > 0).alias("violations"), score.cast("long").alias("score"), level.alias("level"))
