"""Audits as expressions over facts: component tests, image and import scores, route coverage and risk, similarity of markup and types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.text import round_half_up

#: Verbs that functions, not components, start with (fixed values).
VERBS = "handle on get set fetch create update delete is has can should will did toggle open close show hide clear reset submit validate format parse transform filter sort map reduce".split()
VERB_PATTERN = f"^({'|'.join(VERBS)})[A-Z]"
MARKUP_PATTERN = r"return\s*\(\s*<|return\s*<|=>\s*\(\s*<|=>\s*<"
#: Headers that a deployment should send, with the severity of their absence (fixed values).
HEADERS = (
    ("X-Frame-Options", "medium"), ("X-Content-Type-Options", "medium"), ("Referrer-Policy", "medium"), ("X-XSS-Protection", "low"),
    ("Strict-Transport-Security", "high"), ("Content-Security-Policy", "high"), ("Permissions-Policy", "low"),
)
_NEEDED, _WANTED = ["@context", "@type"], ["name", "description", "url", "image"]
#: Required and recommended properties of structured data by type (fixed values).
SCHEMAS = {
    "Product": ([*_NEEDED, "name"], [*_WANTED, "brand", "offers", "review", "aggregateRating"]),
    "Article": ([*_NEEDED, "headline", "author"], [*_WANTED, "datePublished", "dateModified", "publisher"]),
    "LocalBusiness": ([*_NEEDED, "name", "address"], [*_WANTED, "telephone", "openingHours", "priceRange"]),
    "WebPage": ([*_NEEDED, "name"], [*_WANTED, "breadcrumb", "mainEntity"]),
    "FAQPage": ([*_NEEDED, "mainEntity"], _WANTED),
}
#: Weights of the parts of the page health score (fixed values).
HEALTH = {"meta": 0.25, "structure": 0.15, "performance": 0.2, "routing": 0.15, "images": 0.15, "accessibility": 0.1}
SPECIAL = ("template", "error", "loading", "not-found")


def is_component(name: Column, content: Column) -> Column:
    """A capital (or uncased) first character, no verb at the start, and, if there is content, markup that is returned."""
    return name.rlike("^[^a-z]") & ~name.rlike(VERB_PATTERN) & (content.isNull() | content.rlike(MARKUP_PATTERN))


def within(x: Column, lo: float = 0, hi: float = 100) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def image_score(high: Column, medium: Column, low: Column, optimised: Column, lazy: Column, priority: Column, placeholder: Column) -> Column:
    bonus = lambda c, n: F.when(c, n).otherwise(0)
    return within(100 - 25 * high - 15 * medium - 5 * low + bonus(optimised, 10) + bonus(lazy, 10) + bonus(priority, 10) + bonus(placeholder, 5))


def route_risk(coverage: Column, layout: Column, error: Column, dynamic: Column, catch_all: Column, depth: Column) -> tuple[Column, Column]:
    """Points and level."""
    add = lambda c, n: F.when(c, n).otherwise(0)
    points = F.when(coverage < 50, 3).when(coverage < 75, 2).when(coverage < 90, 1).otherwise(0) + add(~layout, 2)
    points = points + F.when(~error, F.when(dynamic, 3).otherwise(1)).otherwise(0) + add(dynamic, 1) + add(catch_all, 1) + add(depth > 3, 1)
    return points, F.when(points >= 6, "critical").when(points >= 4, "high").when(points >= 2, "medium").otherwise("low")


def ancestors(directory: Column) -> Column:
    """A directory and all above it, nearest last; the root is the empty string."""
    parts = F.filter(F.split(directory, "/"), lambda s: s != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def special_files(files: DataFrame, root: str = "app") -> DataFrame:
    """path, kind, found, depth: for each page and kind of special file the nearest one on the way up, null where there is none."""
    name = F.regexp_extract(P.basename(F.col("path")), r"^(.*)\.[jt]sx?$", 1)
    inside = files.where(F.col("path").startswith(root + "/")).select("path", P.dirname(F.col("path")).alias("dir"), name.alias("kind"))
    pages = inside.where("kind = 'page'").select("path", F.explode(ancestors(F.col("dir"))).alias("dir"))
    special = inside.where(F.col("kind").isin("layout", *SPECIAL)).select("dir", "kind", F.col("path").alias("found"))
    met = pages.join(special, "dir").groupBy("path", "kind").agg(F.max_by("found", F.length("dir")).alias("found"), F.count(F.lit(1)).alias("n"))
    wanted = inside.where("kind = 'page'").select("path", F.explode(F.array(*map(F.lit, ("layout", *SPECIAL)))).alias("kind"))
    return wanted.join(met, ["path", "kind"], "left").select("path", "kind", "found", F.coalesce("n", F.lit(0)).alias("n"))


def depth_similarity(tags: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, similarity: mean over depths of the mean over tags of smaller to larger count; tags(component, depth, tag, n)."""
    both = pairs.join(tags, F.col("a") == F.col("component")).select("a", "b", "depth", "tag", F.col("n").alias("na"), F.lit(0).alias("nb")).union(
        pairs.join(tags, F.col("b") == F.col("component")).select("a", "b", "depth", "tag", F.lit(0), F.col("n"))
    )
    per_tag = both.groupBy("a", "b", "depth", "tag").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    per_depth = per_tag.groupBy("a", "b", "depth").agg(F.avg(F.least("na", "nb") / F.greatest("na", "nb")).alias("s"))
    return per_depth.groupBy("a", "b").agg(round_half_up(F.avg("s"), 4).alias("similarity"))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def duplicate_score(props: Column, base: Column, child: Column, style: Column, common: Column) -> Column:
    """Four parts props, six parts structure, less half of what the share of common elements exceeds seven tenths by."""
    less = F.when(common > 0.7, (common - 0.7) * 0.5).otherwise(0.0)
    return F.greatest(F.lit(0.0), round_half_up(props * 0.4 + (base + child + style) / 3 * 0.6 - less, 2))


def function_quality(errors: Column, warnings: Column, infos: Column, return_type: Column, dependencies: Column, calls: Column, body: Column) -> Column:
    plus = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    good = plus((return_type != "") & (return_type != "unknown"), 5) + plus(dependencies > 0, 3) + plus(calls > 0, 3) + plus(F.btrim(body) != "", 5)
    return within(100 - 20 * errors - 10 * warnings - 2 * infos + good)


def type_similarity(props: Column, methods: Column, extends: Column) -> Column:
    return round_half_up(props * 0.6 + methods * 0.3 + extends * 0.1, 3)


def missing_headers(configured: DataFrame, projects: DataFrame) -> DataFrame:
    """project, header, severity of the required headers that a project does not configure."""
    needed = projects.select("project", F.explode(F.array(*(F.struct(F.lit(h).alias("header"), F.lit(s).alias("severity")) for h, s in HEADERS))).alias("x")).select("project", "x.header", "x.severity")
    have = configured.select("project", F.lower("header").alias("low"))
    return needed.withColumn("low", F.lower("header")).join(have, ["project", "low"], "left_anti").drop("low")


def schema_coverage(kind: Column, properties: Column) -> Column:
    """Seven parts the required properties, three parts the recommended ones, in percent."""

    def score(needed: list[str], wanted: list[str]) -> Column:
        share = lambda names: F.size(F.array_intersect(properties, F.array(*map(F.lit, names)))) / len(names)
        return round_half_up(100 * (0.7 * share(needed) + 0.3 * share(wanted)))

    out = reduce(lambda c, k: c.when(kind == k, score(*SCHEMAS[k])), SCHEMAS, F)
    return out.otherwise(score(_NEEDED, _WANTED)).cast("long")


def import_impact(size: Column, pages: Column, server: Column, dynamic: Column, shaking: Column) -> Column:
    add = lambda c, n: F.when(c, n).otherwise(0)
    points = F.when(size == "large", 3).when(size == "medium", 1).otherwise(0) + pages * 2 + add(~server, 2) + add(~dynamic & (pages > 0), 3) + add(shaking, 2) - add(dynamic, 1)
    return F.when(points >= 6, "high").when(points >= 3, "medium").otherwise("low")


def flag_import(size: Column, pages: Column, server: Column, dynamic: Column, shaking: Column) -> Column:
    heavy = size != "small"
    return shaking | ((size == "large") & (pages > 0)) | (heavy & ~dynamic & (~server | (pages > 3)))


def health(meta: Column, structure: Column, performance: Column, routing: Column, images: Column, accessibility: Column) -> Column:
    """The weighted score of suggestion counts by area."""
    part = lambda n, k: F.greatest(F.lit(0), 100 - n * k)
    scores = {"meta": part(meta, 15), "structure": part(structure, 10), "performance": part(performance, 12), "routing": part(routing, 8), "images": part(images, 10), "accessibility": part(accessibility, 12)}
    return round_half_up(sum((scores[k] * w for k, w in HEALTH.items()), F.lit(0.0))).cast("long")


def route_pattern(route: Column) -> Column:
    """A route or link with parameters and numbers as :p."""
    return F.regexp_replace(F.regexp_replace(P.normal_link(route), r"/(:[^/]+|\[[^\]]+\]|[0-9]+)(?=/|$)", "/:p"), r"//+", "/")
