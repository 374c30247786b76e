"""Translations over literal files, entries and sources, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import locales as L
from quarry.plans.common import named, node_table
from quarry.registry import query
from quarry.sources import syntax

FILES = [
    ("locales/en/common.json", '{"hello": "Hello {{name}}", "item_one": "one item", "item_other": "{{count}} items", "deep": {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": {"i": "far"}}}}}}}}}, "list": ["x", "y"]}'),
    ("locales/en/shop.json", '{"greeting": "Hello {{name}}", "buy": "Buy it now", "ok": "Cancel"}'), ("locales/de/common.json", '{"hello": "Hallo", "item_one": "ein Ding", "price": "123.00"}'), ("locales/broken.json", "{no json"),
    ("translations/en.json", '{"x": "never read"}'), ("src/a.ts", "x"),
]


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "path string, content string")


@query("translation_files", f"WITH {named('f', FILES, 'path, content')} SELECT path FROM f WHERE starts_with(path, 'locales/') AND ends_with(path, '.json')")
def translation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the first place that has any."""
    return L.files_of(_files(spark), L.NAMESPACED_FOLDERS).select("path")


#: Entries as reading gives them: path, language, namespace, key, value, plural, base_key, placeholders.
ENTRIES = [
    ("locales/en/common.json", "en", "common", "hello", "Hello {{name}}", "", "hello", "name"), ("locales/en/common.json", "en", "common", "item_one", "one item", "one", "item", ""), ("locales/en/common.json", "en", "common", "item_other", "{{count}} items", "other", "item", "count"),
    ("locales/en/common.json", "en", "common", "deep.a.b.c.d.e.f.g.h.i", "far", "", "deep.a.b.c.d.e.f.g.h.i", ""), ("locales/en/common.json", "en", "common", "list.0", "x", "", "list.0", ""), ("locales/en/common.json", "en", "common", "list.1", "y", "", "list.1", ""),
    ("locales/en/shop.json", "en", "shop", "greeting", "Hello {{name}}", "", "greeting", "name"), ("locales/en/shop.json", "en", "shop", "buy", "Buy it now", "", "buy", ""), ("locales/en/shop.json", "en", "shop", "ok", "Cancel", "", "ok", ""),
    ("locales/de/common.json", "de", "common", "hello", "Hallo", "", "hello", ""), ("locales/de/common.json", "de", "common", "item_one", "ein Ding", "one", "item", ""), ("locales/de/common.json", "de", "common", "price", "123.00", "", "price", ""),
]
_E = named("e", ENTRIES, "path, language, namespace, key, value, plural, base_key, placeholders")
USED = [("common", "hello"), ("common", "item"), ("shop", "greeting"), ("shop", "ok"), ("shop", "gone"), ("cart", "empty")]
_U = named("u", USED, "namespace, key")


def _entries(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(ENTRIES, "path string, language string, namespace string, key string, value string, plural string, base_key string, placeholders string")
    return rows.withColumn("placeholders", F.filter(F.split("placeholders", ","), lambda x: x != ""))


def _used(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(USED, "namespace string, key string")


@query("translation_entries", f"WITH {_E} SELECT path, language, namespace, key, value, plural, base_key, placeholders FROM e")
def translation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text under its key, however deep, with its plural form and placeholders."""
    return L.entries(L.files_of(_files(spark), L.NAMESPACED_FOLDERS)).withColumn("placeholders", F.array_join("placeholders", ","))


_MISSING = f"{_E}, {_U}, k AS (SELECT language, namespace, key FROM e UNION SELECT language, namespace, base_key FROM e), m AS (SELECT u.namespace, u.key, l.language FROM u CROSS JOIN (SELECT DISTINCT language FROM e) l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.language = l.language AND k.namespace = u.namespace AND k.key = u.key))"
_TARGET = f"{_MISSING}, s AS (SELECT language, namespace, path, count(*) AS n FROM e GROUP BY 1, 2, 3), t AS (SELECT m.*, coalesce((SELECT min(path) FROM s WHERE s.language = m.language AND s.namespace = m.namespace), (SELECT arg_max(path, n) FROM s WHERE s.language = m.language)) AS path FROM m)"


@query("namespaced_missing", f"WITH {_MISSING} SELECT * FROM m")
def namespaced_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.missing(_used(spark), _entries(spark))


@query("suggested_files", f"WITH {_TARGET} SELECT * FROM t")
def suggested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark)
    return L.suggested_files(L.missing(_used(spark), e), e)


@query("files_missing_most", f"WITH {_TARGET} SELECT path, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, path LIMIT 5")
def files_missing_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark)
    return L.worst_files(L.suggested_files(L.missing(_used(spark), e), e))


@query(
    "namespaced_duplicates",
    f"""WITH {_E}, {_U} SELECT language, value, string_agg(DISTINCT e.namespace || ':' || e.key, ',' ORDER BY e.namespace || ':' || e.key) AS keys, count(DISTINCT e.namespace) AS namespaces, count(DISTINCT e.namespace) > 1 AS crosses FROM e JOIN (SELECT DISTINCT * FROM u) u ON u.namespace = e.namespace AND u.key = e.key
    WHERE length(value) >= 5 AND lower(trim(value)) NOT IN ({', '.join(repr(v) for v in L.COMMON_VALUES)}) AND NOT regexp_matches(value, '^[\\d\\s.,%-]+$') GROUP BY 1, 2 HAVING count(DISTINCT e.namespace || ':' || e.key) > 1""",
)
def namespaced_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.duplicates(_entries(spark), _used(spark)).withColumn("keys", F.array_join("keys", ","))


@query("uneven_placeholders", f"WITH {_E}, p AS (SELECT namespace, key, list_distinct(flatten(list(list_filter(string_split(placeholders, ','), lambda x: x <> '')))) AS every FROM e GROUP BY 1, 2) SELECT e.namespace, e.key, e.language, array_to_string(list_filter(every, lambda x: NOT list_contains(string_split(e.placeholders, ','), x)), ',') AS lacks FROM e JOIN p USING (namespace, key) WHERE len(list_filter(every, lambda x: NOT list_contains(string_split(e.placeholders, ','), x))) > 0")
def uneven_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.uneven_placeholders(_entries(spark)).withColumn("lacks", F.array_join("lacks", ","))


@query("plural_gaps", f"WITH {_E} SELECT language, namespace, base_key, string_agg(DISTINCT plural, ',' ORDER BY plural) AS forms FROM e WHERE plural <> '' GROUP BY 1, 2, 3 HAVING NOT bool_or(plural IN ('other', 'plural'))")
def plural_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.plural_gaps(_entries(spark)).withColumn("forms", F.array_join("forms", ","))


@query("namespaced_coverage", f"WITH {_E}, {_U} SELECT language, e.namespace, count(*) AS keys, count(u.key) AS used, floor(100.0 * count(u.key) / count(*) + 0.5)::BIGINT AS coverage FROM e LEFT JOIN (SELECT DISTINCT * FROM u) u ON u.namespace = e.namespace AND u.key = e.base_key GROUP BY 1, 2")
def namespaced_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.coverage(_entries(spark), _used(spark))


@query("largest_translation_files", f"WITH {_E} SELECT path, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, path)::INT AS place FROM e GROUP BY 1")
def largest_translation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.largest_first(_entries(spark))


SOURCES = [
    ("src/Home.tsx", "import { useTranslation } from 'react-i18next';\nexport function Home({ ok }) {\n  const { t } = useTranslation('home');\n  const onOpen = () => say(t('opened'));\n  const text = t('title');\n  return <main><h1>{t('title')}</h1>{ok ? <p>{t('yes')}</p> : null}<button onClick={() => t('click')} /></main>;\n}\n"),
    ("src/Cart.tsx", "import { useTranslation } from 'react-i18next';\nexport function Cart() { const { t } = useTranslation(); return <b>{t('title')}</b>; }\n"),
    ("src/Other.tsx", "import { useTranslations } from 'next-intl';\nexport const Other = () => null;\n"),
]


def _nodes(spark: SparkSession) -> DataFrame:
    return syntax.nodes(spark.createDataFrame(SOURCES, "path string, content string"))


_N = node_table(SOURCES)
_EVIDENCE = " UNION ALL ".join(
    f"SELECT '{lib}' AS library, (SELECT count(*) FROM n WHERE kind = 'Import' AND name = '{lib}') AS imports, (SELECT count(*) FROM n WHERE kind = 'Call' AND name = '{hook}') AS hooks, (SELECT count(*) FROM n c JOIN n v ON v.path = c.path AND v.node_id = c.parent_id AND v.kind = 'Variable' WHERE c.kind = 'Call' AND c.name = '{hook}') AS patterns, (SELECT count(DISTINCT path) FROM n WHERE (kind = 'Import' AND name = '{lib}') OR (kind = 'Call' AND name = '{hook}')) AS files"
    for lib, hook in L.HOOKS.items()
)


@query("translation_evidence", f"WITH {_N} {_EVIDENCE}")
def translation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.evidence(_nodes(spark))


@query("translation_library", f"WITH {_N}, v AS ({_EVIDENCE}) SELECT library, least(1.0, (imports > 0)::INT * 0.5 + (hooks > 0)::INT * 0.3 + (patterns > 0)::INT * 0.2 + (files > 1)::INT * 0.1)::DOUBLE AS confidence FROM v ORDER BY confidence DESC, library = 'next-intl' DESC LIMIT 1")
def translation_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From sources to evidence to the likeliest library."""
    return L.detected(L.evidence(_nodes(spark)))


_USE = f"""{_N}, c AS (SELECT c.path, c.node_id, c.line, regexp_replace(s.text, '^[''"]|[''"]$', '', 'g') AS key FROM n c JOIN n s ON s.path = c.path AND s.parent_id = c.node_id AND s.kind = 'String' WHERE c.kind = 'Call' AND regexp_matches(c.name, '^(t|i18n\\.t|translate)$')),
    a AS (SELECT c.*, x.node_id AS a, x.kind AS k, coalesce(x.name, '') AS nm FROM c LEFT JOIN n x ON x.path = c.path AND c.node_id > x.node_id AND c.node_id <= x.exit),
    g AS (SELECT path, line, key, coalesce(bool_or(k = 'JsxExpression'), false) AS in_markup, coalesce(bool_or(k IN ('Conditional', 'If')), false) AS in_choice, coalesce(bool_or(k IN ('Function', 'JsxAttribute', 'Property') AND regexp_matches(nm, '^(on|handle)[A-Z]')), false) AS in_handler, arg_max(nm, a) FILTER (k = 'JsxElement') AS parent, arg_min(nm, a) FILTER (k = 'Function' AND regexp_matches(nm, '^[A-Z]')) AS component FROM a GROUP BY path, node_id, line, key)"""


@query("translation_contexts", f"WITH {_USE} SELECT * FROM g")
def translation_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where translation calls stand."""
    return L.usage_contexts(_nodes(spark))


@query("translation_renders", f"WITH {_USE} SELECT key, count(*) AS n, count(DISTINCT component) AS components, count_if(in_markup) AS in_markup FROM g GROUP BY 1")
def translation_renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.render_counts(L.usage_contexts(_nodes(spark)))
