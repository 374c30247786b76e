"""Translations: files by library and place, keys with namespaces, plurals and placeholders, what is missing, doubled, and where to add it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import round_half_up

# Where files lie, in order; the first place with files counts.
FOLDERS = ("messages", "locales", "translations", "i18n/locales", "src/locales", "public/locales")
NAMESPACED_FOLDERS = ("locales", "public/locales", "src/locales", "assets/locales", "translations", "i18n", "src/i18n")
HOOKS = {"next-intl": "useTranslations", "react-i18next": "useTranslation"}
PLURALS = r"_(zero|one|two|few|many|other|plural)$"
#: Values that are equal in many places without being one text.
COMMON_VALUES = ("yes", "no", "ok", "cancel", "save", "delete", "edit", "close", "true", "false")


def files_of(files: DataFrame, folders: tuple[str, ...] = FOLDERS) -> DataFrame:
    """The JSON files of the first of the folders that has any."""
    rank = F.lit(None).cast("int")
    for i, folder in reversed(list(enumerate(folders))):
        rank = F.when(F.col("path").startswith(folder + "/"), i).otherwise(rank)
    own = files.where(F.col("path").endswith(".json")).withColumn("rank", rank).where("rank is not null")
    first = own.agg(F.min("rank").alias("first"))
    return own.join(F.broadcast(first)).where("rank = first").drop("rank", "first")  # one row


def flattened(files: DataFrame) -> DataFrame:
    """path, key, value: every text of nested JSON files under its dotted key, however deep; files that aren't JSON have none."""

    def leaves(prefix: str, value: object) -> Iterator[tuple[str, str]]:
        stack = [(prefix, value)]
        while stack:
            at, v = stack.pop()
            if isinstance(v, dict):
                stack += [(f"{at}.{k}" if at else str(k), x) for k, x in v.items()]
            elif isinstance(v, list):
                stack += [(f"{at}.{i}", x) for i, x in enumerate(v)]
            elif v is not None:
                yield at, str(v) if not isinstance(v, bool) else str(v).lower()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, k, v) for k, v in leaves("", json.loads(content))]
                except (ValueError, TypeError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "key", "value"])

    return files.select("path", "content").mapInPandas(run, "path string, key string, value string")


def language_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(?:^|/)([a-z]{2}(?:-[A-Z]{2})?)(?:/|\.json$)", 1)


def namespace_of(path: Column) -> Column:
    """The file's name where a folder names the language, else empty."""
    return F.regexp_extract(path, r"/[a-z]{2}(?:-[A-Z]{2})?/([^/]+)\.json$", 1)


def entries(files: DataFrame) -> DataFrame:
    """path, language, namespace, key, value, plural (the form that a key ends in), base_key, placeholders."""
    f = flattened(files)
    return f.select(
        "path", language_of(F.col("path")).alias("language"), namespace_of(F.col("path")).alias("namespace"), "key", "value", F.regexp_extract("key", PLURALS, 1).alias("plural"), F.regexp_replace("key", PLURALS, "").alias("base_key"),
        F.array_distinct(F.regexp_extract_all("value", F.lit(r"\{\{?\s*([\w.]+)[^{}]*\}?\}"), F.lit(1))).alias("placeholders"),
    )


def evidence(nodes: DataFrame) -> DataFrame:
    """library, imports, hooks, patterns, files: what in the sources speaks for a library of translations."""
    out = None
    for library, hook in HOOKS.items():
        held = nodes.where("kind = 'Variable'").select("path", F.col("node_id").alias("parent_id"), F.col("name").alias("variable"))
        calls = nodes.where((F.col("kind") == "Call") & (F.col("name") == hook)).select("path", "parent_id")
        bound = calls.join(held, ["path", "parent_id"])
        one = lambda df, what: df.select(F.lit(what).alias("what"), "path")
        rows = one(nodes.where((F.col("kind") == "Import") & (F.col("name") == library)), "import").union(one(calls, "hook")).union(one(bound, "pattern"))
        per = rows.agg(*(F.count_if(F.col("what") == w).alias(n) for w, n in (("import", "imports"), ("hook", "hooks"), ("pattern", "patterns"))), F.countDistinct("path").alias("files")).select(F.lit(library).alias("library"), "imports", "hooks", "patterns", "files")
        out = per if out is None else out.union(per)
    return out


def detected(found: DataFrame) -> DataFrame:
    """library, confidence: the likeliest, the first of equals as HOOKS has them; no row where nothing speaks for any."""
    has = lambda c, w: F.when(F.col(c) > 0, w).otherwise(0.0)
    sure = F.least(F.lit(1.0), has("imports", 0.5) + has("hooks", 0.3) + has("patterns", 0.2) + F.when(F.col("files") > 1, 0.1).otherwise(0.0))
    place = F.array_position(F.array(*map(F.lit, HOOKS)), F.col("library"))
    return found.select("library", round_half_up(sure, 2).alias("confidence"), place.alias("place")).where("confidence > 0").orderBy(F.desc("confidence"), "place").limit(1).drop("place")


def usage_contexts(nodes: DataFrame) -> DataFrame:
    """path, line, key, in_markup, in_choice, in_handler, parent, component: where translation calls (a text handed to t) stand."""
    calls = nodes.where("kind = 'Call' and name rlike '^(t|i18n\\\\.t|translate)$'").select("path", "node_id", "line")
    texts = nodes.where("kind = 'String'").select("path", F.col("parent_id").alias("node_id"), F.regexp_replace("text", "^['\"]|['\"]$", "").alias("key"))
    rows = calls.join(texts, ["path", "node_id"])
    around = nodes.where("kind in ('JsxExpression', 'JsxElement', 'Conditional', 'Logical', 'If', 'Function', 'JsxAttribute', 'Property')").select(F.col("path").alias("p"), F.col("node_id").alias("a"), F.col("exit").alias("until"), F.col("kind").alias("k"), F.col("name").alias("n"))
    met = rows.join(around, (F.col("path") == F.col("p")) & (F.col("node_id") > F.col("a")) & (F.col("node_id") <= F.col("until")), "left")
    k, n = F.col("k"), F.coalesce("n", F.lit(""))
    no = lambda c: F.coalesce(F.max(c), F.lit(False))
    return met.groupBy("path", "node_id", "line", "key").agg(
        no(k == "JsxExpression").alias("in_markup"), no(k.isin("Conditional", "If")).alias("in_choice"), no((k.isin("Function", "JsxAttribute", "Property")) & n.rlike("^(on|handle)[A-Z]")).alias("in_handler"),
        F.max_by(F.when(k == "JsxElement", n), F.when(k == "JsxElement", F.col("a"))).alias("parent"), F.min_by(F.when((k == "Function") & n.rlike("^[A-Z]"), n), F.when((k == "Function") & n.rlike("^[A-Z]"), F.col("a"))).alias("component"),
    ).drop("node_id")


def render_counts(used: DataFrame) -> DataFrame:
    return used.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("component").alias("components"), F.count_if("in_markup").alias("in_markup"))


def missing(used: DataFrame, known: DataFrame) -> DataFrame:
    """namespace, key, language: keys in use that a language lacks, plural forms counting for their base; used(namespace, key),
    known(language, namespace, key, base_key). Languages are few, so each key carries their list."""
    languages = known.agg(F.collect_set("language").alias("languages"))
    wanted = used.select("namespace", "key").distinct().join(F.broadcast(languages)).select("namespace", "key", F.explode("languages").alias("language"))
    both = known.select("language", "namespace", F.explode(F.array_distinct(F.array("key", "base_key"))).alias("key")).distinct()
    return wanted.join(both, ["language", "namespace", "key"], "left_anti").select("namespace", "key", "language")


def suggested_files(gaps: DataFrame, known: DataFrame) -> DataFrame:
    """namespace, key, language, path: the file to add a missing key to: the language's file of the namespace, else its largest."""
    sizes = known.groupBy("language", "namespace", "path").agg(F.count(F.lit(1)).alias("n"))
    exact = sizes.groupBy("language", "namespace").agg(F.min("path").alias("exact"))
    largest = sizes.groupBy("language").agg(F.min_by("path", F.struct((-F.col("n")).alias("n"), "path")).alias("largest"))
    rows = gaps.join(exact, ["language", "namespace"], "left").join(largest, "language", "left")
    return rows.select("namespace", "key", "language", F.coalesce("exact", "largest").alias("path"))


def worst_files(gaps: DataFrame, most: int = 5) -> DataFrame:
    """path, n: the files that lack most keys."""
    return gaps.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(most)


def duplicates(known: DataFrame, used: DataFrame) -> DataFrame:
    """value, keys, namespaces, crosses: texts of five characters and more, no common words and no numbers, that several keys of one
    language hold and that are used; crosses tells whether they lie in several namespaces."""
    v = F.lower(F.btrim("value"))
    plain = known.where((F.length("value") >= 5) & ~v.isin(*COMMON_VALUES) & ~v.rlike(r"^[\d\s.,%-]+$"))
    named = plain.join(used.select("namespace", "key").distinct(), ["namespace", "key"], "left_semi")
    g = named.groupBy("language", "value").agg(F.countDistinct(F.concat_ws(":", "namespace", "key")).alias("n"), F.sort_array(F.collect_set(F.concat_ws(":", "namespace", "key"))).alias("keys"), F.countDistinct("namespace").alias("namespaces"))
    return g.where("n > 1").select("language", "value", "keys", "namespaces", (F.col("namespaces") > 1).alias("crosses"))


def uneven_placeholders(known: DataFrame) -> DataFrame:
    """namespace, key, language, lacks: placeholders that other languages have and this one doesn't."""
    every = known.groupBy("namespace", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("placeholders")))).alias("all"))
    rows = known.join(every, ["namespace", "key"]).select("namespace", "key", "language", F.array_except("all", "placeholders").alias("lacks"))
    return rows.where("size(lacks) > 0")


def plural_gaps(known: DataFrame) -> DataFrame:
    """language, namespace, base_key, forms: plural keys without the form for all other numbers."""
    g = known.where("plural <> ''").groupBy("language", "namespace", "base_key").agg(F.sort_array(F.collect_set("plural")).alias("forms"))
    return g.where(~F.array_contains("forms", "other") & ~F.array_contains("forms", "plural"))


def coverage(known: DataFrame, used: DataFrame) -> DataFrame:
    """language, namespace, keys, used, coverage (percent, rounded)."""
    rows = known.join(used.select("namespace", F.col("key").alias("base_key")).distinct().withColumn("hit", F.lit(1)), ["namespace", "base_key"], "left")
    return rows.groupBy("language", "namespace").agg(F.count(F.lit(1)).alias("keys"), F.count("hit").alias("used"), round_half_up(100 * F.count("hit") / F.count(F.lit(1))).cast("long").alias("coverage"))


def largest_first(known: DataFrame) -> DataFrame:
    """path, n, place: files by number of keys."""
    n = known.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "path")))  # one row a file
