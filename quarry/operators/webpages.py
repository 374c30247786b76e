"""Pages in source form: images, loading, vitals, heavy imports, resources, structured data, metadata, special files and router facts.

elements: path, node_id, exit, tag, props, own_text, line, as code.elements gives them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.text import round_half_up
from quarry.operators import audits as A

# Libraries by size, and those whose parts should be imported singly.
LARGE = ("lodash", "moment", "chart.js", "three", "@tensorflow/tfjs", "monaco-editor", "codemirror", "pdf-lib", "fabric", "antd", "@mui/material", "react-bootstrap", "semantic-ui-react")
MEDIUM = ("axios", "react-router", "formik", "yup", "date-fns", "framer-motion", "react-spring", "styled-components", "emotion", "@apollo/client", "redux-toolkit", "recharts")
SMALL = ("react", "react-dom", "next", "lucide-react", "clsx", "class-variance-authority", "tailwind-merge", "@tanstack/react-query", "zustand", "next-themes", "sonner", "zod")
SINGLE = ("lodash", "date-fns", "ramda", "rxjs")
FORMATS = {"jpg": "JPEG", "jpeg": "JPEG", "png": "PNG", "gif": "GIF", "svg": "SVG", "webp": "WebP", "avif": "AVIF"}
META = ("title", "description", "robots", "canonical", "viewport", "og:title", "og:description", "og:image", "og:url", "twitter:card", "twitter:title", "twitter:description", "twitter:image")


def _p(name: str) -> Column:
    return F.col("props")[name]


def _given(name: str) -> Column:
    return F.coalesce(_p(name), F.lit("")) != ""


def image_format(src: Column) -> Column:
    ext = F.lower(F.regexp_extract(src, r"\.([A-Za-z]+)(?:[?#].*)?$", 1))
    return reduce(lambda c, k: c.when(ext == k, FORMATS[k]), FORMATS, F).otherwise(None)


def images(elements: DataFrame) -> DataFrame:
    """path, line, src, kind, format, issues (name:severity), score of img and Image elements and of background images in styles."""
    tag, src = F.col("tag"), F.coalesce(_p("src"), F.lit(""))
    plain, next_image = tag == "img", tag == "Image"
    form = image_format(src)
    issue = lambda condition, name, severity: F.when(condition, F.lit(f"{name}:{severity}"))
    none = _p("alt").isNull()
    both = _given("width") & _given("height")
    found = F.array_compact(F.array(
        issue(none, "missing-alt", "high"), issue(plain & ~both, "missing-dimensions", "medium"), issue(plain & (src != "") & ~src.startswith("data:"), "no-optimization", "high"),
        issue(next_image & ~_given("sizes") & ~_given("fill") & ~_given("width"), "missing-sizes", "medium"), issue(next_image & ~F.coalesce(_p("priority").isin("true", "{true}"), F.lit(False)), "no-priority", "low"),
        issue(form.isin("PNG", "JPEG", "GIF"), "large-format", "medium"), issue(form.isin("PNG", "JPEG"), "wrong-format", "medium"),
    ))
    rows = elements.where(plain | next_image).select(
        "path", "line", src.alias("src"), F.when(next_image, "next/image").otherwise("img").alias("kind"), form.alias("format"), found.alias("issues"),
        next_image.alias("optimised"), (F.length(F.coalesce(_p("alt"), F.lit(""))) > 0).alias("named"), both.alias("sized"), _given("placeholder").alias("placeholder"),
    )
    n = lambda s: F.size(F.filter("issues", lambda x: x.endswith(":" + s)))
    scored = rows.select("path", "line", "src", "kind", "format", "issues", A.image_score(n("high"), n("medium"), n("low"), F.col("optimised"), F.col("named"), F.col("sized"), F.col("placeholder")).alias("score"))
    url = F.regexp_extract(F.coalesce(_p("style"), F.lit("")), r"url\(['\"]?([^'\")]+)['\"]?\)", 1)
    back = elements.where(_p("style").contains("background") & (url != "")).select("path", "line", url.alias("src"), F.lit("background-image").alias("kind"), image_format(url).alias("format"), F.array(F.lit("no-optimization:medium")).alias("issues"), F.lit(30).alias("score"))
    return scored.union(back)


def image_statistics(found: DataFrame) -> DataFrame:
    """format, n, average (score), with_issues: a row a format."""
    return found.groupBy("format").agg(F.count(F.lit(1)).alias("n"), round_half_up(F.avg("score")).cast("long").alias("average"), F.count_if(F.size("issues") > 0).alias("with_issues"))


def vitals(elements: DataFrame, files: DataFrame) -> DataFrame:
    """path, line, vital, severity, tag: what moves or delays a page: elements without a size, images that come first without priority,
    fonts without a connection, large handlers. files(path, n_lines); an image in the first fifth of its file comes first."""
    tag = F.col("tag")
    sized = _given("width") & _given("height")
    rows = elements.join(files, "path")
    above = F.col("line") <= F.greatest(F.lit(1.0), F.col("n_lines") * 0.2)
    v = lambda condition, vital, severity: F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(vital).alias("vital"), F.lit(severity).alias("severity")))
    handler = F.coalesce(_p("onClick"), F.lit(""))
    found = F.array_compact(F.array(
        v((tag == "img") & ~sized, "CLS", "medium"), v((tag == "img") & _given("src") & ~_given("priority") & above, "LCP", "high"), v((tag == "Image") & ~_given("priority") & above, "LCP", "high"), v((tag == "Image") & ~_given("sizes"), "LCP", "medium"),
        v((F.length(handler) > 200) | handler.rlike(r"await |for\s*\(|while\s*\("), "INP", "medium"), v(tag.isin("iframe", "embed", "object") & ~sized, "CLS", "high"), v((tag == "link") & (_p("rel") == "stylesheet") & _p("href").contains("fonts.googleapis.com"), "LCP", "medium"),
    ))
    return rows.select("path", "line", "tag", F.explode(found).alias("x")).select("path", "line", "x.vital", "x.severity", "tag")


def vital_statistics(found: DataFrame) -> DataFrame:
    return found.groupBy("vital").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("pages"), F.count_if(F.col("severity") == "high").alias("high"))


def lazy_loading(components: DataFrame, dynamic: DataFrame, imports: DataFrame, used: DataFrame) -> DataFrame:
    """path, name, is_lazy, should_be_lazy, n_pages: components that load later, or should: long ones, and those with heavy imports that
    pages use. components(path, name, n_lines), dynamic(path), imports(path, size), used(path, name, n_pages)."""
    lazy = dynamic.select("path", F.lit(True).alias("is_lazy")).distinct()
    heavy = imports.where("size = 'large'").select("path", F.lit(True).alias("heavy")).distinct()
    rows = components.join(lazy, "path", "left").join(heavy, "path", "left").join(used, ["path", "name"], "left")
    is_lazy, big = F.coalesce("is_lazy", F.lit(False)), F.coalesce("heavy", F.lit(False)) | (F.col("n_lines") > 200)
    return rows.select("path", "name", is_lazy.alias("is_lazy"), (big & ~is_lazy).alias("should_be_lazy"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


def lazy_images(elements: DataFrame, files: DataFrame) -> DataFrame:
    """path, line, src, lazy, first: images, whether they load later, and whether they come first."""
    rows = elements.where(F.col("tag").isin("img", "Image")).join(files, "path")
    lazy = (F.coalesce(_p("loading"), F.lit("")) == "lazy") | ((F.col("tag") == "Image") & ~_given("priority"))
    return rows.select("path", "line", F.coalesce(_p("src"), F.lit("")).alias("src"), lazy.alias("lazy"), (F.col("line") <= F.greatest(F.lit(1.0), F.col("n_lines") * 0.2)).alias("first"))


def library_size(specifier: Column) -> Column:
    """small, medium or large: by name, and medium where a package is unknown."""
    name = P.package_name(specifier)
    small = reduce(lambda c, x: c | (name == x), SMALL, F.lit(False))
    return F.when(small | specifier.rlike(r"^(\.|/|@/)"), "small").when(name.isin(*LARGE), "large").when(name.isin(*MEDIUM), "medium").otherwise("medium")


def heavy_imports(imports: DataFrame) -> DataFrame:
    """specifier, size, n_files, pages, dynamic, server, whole, impact, flagged of imports(path, specifier, dynamic, is_page, is_server)."""
    whole = F.col("specifier").isin(*SINGLE)
    per = imports.withColumn("size", library_size(F.col("specifier"))).groupBy("specifier", "size").agg(
        F.countDistinct("path").alias("n_files"), F.countDistinct(F.when(F.col("is_page"), F.col("path"))).alias("pages"), F.min("dynamic").alias("dynamic"), F.min("is_server").alias("server"), F.max(whole).alias("whole"),
    )
    args = (F.col("size"), F.col("pages"), F.col("server"), F.col("dynamic"), F.col("whole"))
    return per.withColumns({"impact": A.import_impact(*args), "flagged": A.flag_import(*args)})


def critical_resources(elements: DataFrame) -> DataFrame:
    """path, line, kind, address, preloaded, blocks: style sheets, scripts and fonts of a page's head, whether a preload names them, and
    whether they hold up the page."""
    tag = F.col("tag")
    href = F.coalesce(_p("href"), _p("src"), F.lit(""))
    kind = F.when((tag == "link") & (_p("rel") == "stylesheet"), "style").when(tag.isin("script", "Script"), "script").when((tag == "link") & href.rlike(r"\.woff2?$"), "font")
    later = F.coalesce(_p("async").isNotNull() | _p("defer").isNotNull() | _p("strategy").isin("lazyOnload", "afterInteractive"), F.lit(False))
    rows = elements.withColumns({"kind": kind, "address": href}).where("kind is not null and address <> ''").select("path", "line", "kind", "address", later.alias("later"))
    ahead = elements.where((tag == "link") & (_p("rel") == "preload")).select("path", _p("href").alias("address"), F.lit(True).alias("preloaded")).distinct()
    out = rows.join(ahead, ["path", "address"], "left").withColumn("preloaded", F.coalesce("preloaded", F.lit(False)))
    return out.select("path", "line", "kind", "address", "preloaded", (F.col("kind").isin("style", "script") & ~F.col("later")).alias("blocks"))


def page_counters(elements: DataFrame) -> DataFrame:
    """path, images, missing_alt, decorative, aria, misused_aria, buttons, buttons_without_text, inputs, unlabelled: a row a file."""
    tag, text = F.lower("tag"), F.btrim("own_text")
    button = (tag == "button") | (F.coalesce(_p("role"), F.lit("")) == "button")
    aria = F.filter(F.map_keys("props"), lambda k: k.startswith("aria-"))
    misuse = F.coalesce(F.exists(F.map_entries("props"), lambda e: e.key.startswith("aria-") & (F.btrim(e.value) == "")), F.lit(False))
    labels = elements.where("lower(tag) = 'label'").select("path", F.coalesce(_p("htmlFor"), _p("for")).alias("own_id"), F.lit(True).alias("labelled")).where("own_id is not null").distinct()
    rows = elements.withColumn("own_id", _p("id")).join(labels, ["path", "own_id"], "left")
    named = F.coalesce("labelled", F.lit(False)) | _p("aria-label").isNotNull() | _p("aria-labelledby").isNotNull()
    return rows.groupBy("path").agg(
        F.count_if(tag == "img").alias("images"), F.count_if((tag == "img") & _p("alt").isNull()).alias("missing_alt"), F.count_if((tag == "img") & (_p("alt") == "")).alias("decorative"), F.sum(F.size(aria)).alias("aria"), F.count_if(misuse).alias("misused_aria"),
        F.count_if(button).alias("buttons"), F.count_if(button & (text == "") & _p("aria-label").isNull() & ~F.coalesce(_p("children").isNotNull(), F.lit(False))).alias("buttons_without_text"), F.count_if(tag == "input").alias("inputs"), F.count_if((tag == "input") & ~named).alias("unlabelled"),
    )


def structured_data(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, type, properties, coverage, missing: JSON-LD blocks of pages, with the properties that they should have."""
    blocks = pages.select("page_id", F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))).alias("block"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            out = []
            for page, block in zip(b["page_id"], b["block"], strict=True):
                try:
                    value = json.loads(block)
                except ValueError:
                    continue
                items = value.get("@graph", [value]) if isinstance(value, dict) else value if isinstance(value, list) else []
                out += [(page, str(x.get("@type", "Unknown")), sorted(x)) for x in items if isinstance(x, dict)]
            yield pd.DataFrame(out, columns=["page_id", "type", "properties"])

    found = blocks.mapInPandas(run, "page_id long, type string, properties array<string>")
    return found.withColumns({"coverage": A.schema_coverage(F.col("type"), F.col("properties")), "missing": missing_properties(F.col("type"), F.col("properties"))})


def missing_properties(kind: Column, properties: Column) -> Column:
    needed = reduce(lambda c, k: c.when(kind == k, F.array(*map(F.lit, A.SCHEMAS[k][0]))), A.SCHEMAS, F).otherwise(F.array(F.lit("@context"), F.lit("@type")))
    return F.array_except(needed, properties)


def schema_statistics(found: DataFrame) -> DataFrame:
    """One row: blocks, pages, blocks a page, types that come twice or more."""
    n = found.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    common = n.agg(F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.concat_ws(":", "type", "n")))).alias("common"))
    one = found.agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("page_id").alias("pages"), round_half_up(F.try_divide(F.count(F.lit(1)), F.countDistinct("page_id")), 2).alias("per_page"))
    return one.join(F.broadcast(common))  # one row each


def meta_tags(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, tag, present, length of the title and the meta tags that a page should have."""
    h = F.col(html)
    attribute = lambda name, of, value: F.coalesce(F.nullif(F.regexp_extract(h, rf"(?is)<{of}[^>]*{name}=[\"']{value}[\"'][^>]*(?:content|href)=[\"']([^\"']*)[\"']", 1), F.lit("")), F.nullif(F.regexp_extract(h, rf"(?is)<{of}[^>]*(?:content|href)=[\"']([^\"']*)[\"'][^>]*{name}=[\"']{value}[\"']", 1), F.lit("")))
    value = {"title": F.nullif(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")), "canonical": attribute("rel", "link", "canonical")}
    rows = F.array(*(F.struct(F.lit(t).alias("tag"), (value[t] if t in value else attribute("(?:name|property)", "meta", t)).alias("v")) for t in META))
    return pages.select("page_id", F.explode(rows).alias("x")).select("page_id", "x.tag", F.col("x.v").isNotNull().alias("present"), F.coalesce(F.length(F.btrim("x.v")), F.lit(0)).alias("length"))


def mixed_content(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, tag, address: resources that a page loads by http."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<(?:img|script|iframe|audio|video|source|embed|link|object)\b[^>]*?(?:src|href|data)=[\"']http://[^\"']+[\"']"), F.lit(0))
    rows = pages.select("page_id", F.explode(found).alias("m"))
    return rows.select("page_id", F.lower(F.regexp_extract("m", r"(?is)^<(\w+)", 1)).alias("tag"), F.regexp_extract("m", r"(?is)=[\"'](http://[^\"']+)[\"']$", 1).alias("address"))


def layout_conflicts(metadata: DataFrame) -> DataFrame:
    """path, field, above: metadata that a layout sets and one above it sets too; metadata(path, field) of layouts."""
    own = metadata.select("path", "field", P.dirname(F.col("path")).alias("dir"))
    up = own.select("path", "field", "dir", F.explode(A.ancestors(F.col("dir"))).alias("up")).where("up <> dir")
    met = up.join(own.select(F.col("path").alias("other"), F.col("field").alias("f2"), F.col("dir").alias("up")), "up").where("field = f2")
    return met.groupBy("path", "field").agg(F.max_by("other", F.length("up")).alias("above"))


def special_file_issues(files: DataFrame) -> DataFrame:
    """path, issue: what files of the router lack: an error file that isn't for the client, without reset; a layout without children; a
    page or layout without a default export; a loading file that waits."""
    c, name = F.col("content"), P.stem(F.col("path"))
    i = lambda condition, issue: F.when(condition, F.lit(issue))
    found = F.array_compact(F.array(
        i(name.isin("error", "global-error") & ~c.rlike(r"^\s*['\"]use client['\"]"), "error-not-client"), i(name.isin("error", "global-error") & ~c.contains("reset"), "error-without-reset"), i((name == "global-error") & ~c.contains("<html"), "global-error-without-html"),
        i(name.isin("layout", "template") & ~c.contains("children"), "layout-without-children"), i(name.isin("page", "layout", "template", "error", "loading", "not-found") & ~c.contains("export default"), "no-default-export"), i((name == "loading") & c.contains("await "), "loading-waits"),
    ))
    return files.where(F.col("path").rlike(r"(^|/)app/.*\.[jt]sx?$")).select("path", F.explode(found).alias("issue"))


def router_facts(paths: DataFrame) -> DataFrame:
    """path, groups, slots, intercepts, dynamic, catch_all, readiness of files below app/: what folders say about routes. Readiness adds up
    the special files of the folder: layout 30, error 30, loading 20, not-found 20."""
    own = paths.where(F.col("path").rlike("(^|/)app/")).withColumn("segments", F.split(F.regexp_extract("path", "(?:^|/)app/(.*)$", 1), "/"))
    seg = lambda pattern: F.filter("segments", lambda s: s.rlike(pattern))
    points = F.when(P.stem(F.col("path")) == "layout", 30).when(P.stem(F.col("path")) == "error", 30).when(P.stem(F.col("path")) == "loading", 20).when(P.stem(F.col("path")) == "not-found", 20).otherwise(0)
    ready = own.select(P.dirname(F.col("path")).alias("dir"), points.alias("x")).groupBy("dir").agg(F.sum("x").alias("readiness"))
    rows = own.select("path", P.dirname(F.col("path")).alias("dir"), seg(r"^\([^.].*\)$").alias("groups"), seg("^@").alias("slots"), seg(r"^\(\.+\)").alias("intercepts"), (F.size(seg(r"^\[[^.\]]+\]$")) > 0).alias("dynamic"), (F.size(seg(r"^\[\[?\.\.\.")) > 0).alias("catch_all"))
    return rows.join(ready, "dir").drop("dir")


def route_map(paths: DataFrame) -> DataFrame:
    """route, path: the page file that serves each route; of several the first by name."""
    pages = paths.where(F.col("path").rlike(r"(^|/)app/(.*/)?page\.[jt]sx?$") | (F.col("path").rlike(r"(^|/)pages/.*\.[jt]sx?$") & ~F.col("path").rlike(r"(^|/)pages/(api/|_)")))
    return pages.groupBy(P.route_of_file(F.col("path")).alias("route")).agg(F.min("path").alias("path"))


def suggestions(sites: DataFrame) -> DataFrame:
    """site, area, n, text: a sentence for each area with problems; sites(site, and a count for each area of audits.HEALTH)."""
    rows = F.array(*(F.struct(F.lit(a).alias("area"), F.col(a).alias("n")) for a in A.HEALTH))
    return sites.select("site", F.explode(rows).alias("x")).select("site", "x.area", "x.n", F.format_string("%d findings on %s.", F.col("x.n"), F.col("x.area")).alias("text")).where("n > 0")


def coverage_advice(facts: DataFrame) -> DataFrame:
    """route, advice: what to add, by coverage and what is missing; facts(route, coverage, layout, error, loading, dynamic)."""
    c = F.col
    found = F.array_compact(F.array(
        F.when(~c("error"), F.when(c("dynamic"), "add an error file: the route takes parameters").otherwise("add an error file")), F.when(~c("layout"), "add a layout"), F.when(~c("loading"), "add a loading file"), F.when(c("coverage") < 50, "cover the route: less than half of the files are there"),
    ))
    return facts.select("route", F.explode(found).alias("advice"))
