"""Rule findings over source files, their deduplication, metrics and scores; packages, environment files and translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.text import round_half_up
from quarry.operators import findings as R
from quarry.plans.common import table, values
from quarry.plans.pages import _LINK_NORMAL, _LINKS, _NORMAL, _PATH
from quarry.registry import query
from quarry.sources import pages as H

#: Source files: path, content (fixture).
FILES = [
    ("src/a.ts", "import x from 'lodash/get';\nconst r = Math.random();\neval(input);\n// eval(no)\nconst u = 'http://example.org/a';\n"),
    ("src/b.tsx", "import React, { useState } from 'react';\nimport { q } from '@tanstack/react-query/core';\nimport './b.css';\nel.innerHTML = x;\nel.innerHTML = y;\nconsole.log('password', password);\n"),
    ("src/c.js", "const fs = require('fs');\nsetTimeout(\"go()\", 5);\ndocument.cookie = 'a';\nlocalStorage.setItem('token', t);\nconst k = process.env.API_KEY + process.env.HOME;\n"),
    ("src/clean.ts", "export const add = (a: number, b: number) => a + b;\n"),
    ("src/every.tsx", "new Function (s); setInterval('x', 1); execScript (s);\nconst h = { dangerouslySetInnerHTML: x };\nel.outerHTML = x; document.write(x); document.writeln(x);\nconsole.warn('t', token); console.error(secret); console.info(api_key);\nReact.createElement('script');\n<script src=\"http://a.b/c.js\">{code}</script>\n<img src=\"http://a.b/c.png\" />\nconst q = `${x} SELECT a`;\ndb.query('SELECT a ' + b);\nDate.now() % 7;\nfetch('http://a.b'); axios.get('http://a.b');\nprocess.env.SECRET_KEY;\ndebugger;\ndebugger\nconst isDev = true;\nconsole.trace(x);\nif (isDebug) {}\nconst r = /(a+)+b/; const s = /(x{2}y)z*/;\nimport fs from 'fs';\nconst pg = require('pg');\n"),
    ("src/more.js", "document.cookie = 'a=b; Secure; HttpOnly';\ndocument.cookie = 'c=d; SameSite=Lax';\nsessionStorage.getItem('jwt');\nindexedDB.open('x');\nrouter.push(searchParams.get('u'));\nwindow.location = params.u;\nredirect(req.query.u);\nconst apiKey = 'abcdefghijkl';\n<script>{x}</script>\n"),
    ("notes.md", "eval(x) is listed in no extension of code\n"),
]
_FILES = values(FILES, "path, content")


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "path string, content string")


def _sql_pattern(p: str) -> str:
    return p.replace("'", "''")


def _sql_count(r: R.Rule) -> str:
    """How often a rule matches. The SQL dialect has no look-ahead: what must not follow is looked for in the rest of the line."""
    if "(?!" in r.pattern:
        word = r.pattern[r.pattern.index("(?!.*") + 5 : -1]
        return f"len(list_filter(regexp_extract_all(content, 'document\\.cookie\\s*=[^\\n]*'), lambda x: NOT regexp_matches(x, '{word}')))"
    return f"len(regexp_extract_all(content, '{_sql_pattern(r.pattern)}'))"


_COUNTS = " UNION ALL ".join(
    f"SELECT path, '{r.id}' AS rule, '{r.kind}' AS type, '{r.severity}' AS severity, {_sql_count(r)} AS n FROM {_FILES} WHERE regexp_matches(path, '\\.({'|'.join(e[1:] for e in r.extensions)})$')" for r in R.RULES
)


@query("rule_matches", f"SELECT path, rule, type, severity, n FROM ({_COUNTS}) WHERE n > 0")
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.match_rules(_files(spark)).groupBy("path", "rule", "type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("findings_with_position")
def findings_with_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings outside of comment lines, where they are."""
    files = _files(spark)
    return R.drop_commented(R.match_rules(files), files).select("path", "rule", "line", "column")


_SEVERITY = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END"
_CONFIDENCE = "CASE WHEN value >= 150 THEN 'high' WHEN value >= 75 THEN 'medium' ELSE 'low' END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    severity = F.when(kind == "error", "critical").when(kind == "purchase", "high").when(kind == "signup", "medium").otherwise("low")
    confidence = F.when(value >= 150, "high").when(value >= 75, "medium").otherwise("low")
    return table(spark, sf_dir, "events").select("event_id", "user_id", kind.alias("type"), severity.alias("severity"), confidence.alias("confidence"))


@query(
    "findings_dedup",
    f"""SELECT user_id, type, event_id, severity, confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id, type ORDER BY CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, event_id) AS turn
    FROM (SELECT event_id, user_id, event_type AS type, {_SEVERITY} AS severity, {_CONFIDENCE} AS confidence FROM events)) WHERE turn = 1""",
)
def findings_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.deduplicated(_events(spark, sf_dir), "user_id", "type", seq="event_id").select("user_id", "type", "event_id", "severity", "confidence")


_RISK = """CASE WHEN critical > 0 THEN 'critical' WHEN high > 2 THEN 'high' WHEN high > 0 OR medium > 5 THEN 'medium' WHEN medium > 0 OR low > 10 THEN 'low' ELSE 'none' END"""
_BY_USER = f"""SELECT user_id, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium, count_if(severity = 'low') AS low, count(*) AS total
    FROM (SELECT user_id, {_SEVERITY} AS severity FROM events) GROUP BY user_id"""


@query(
    "security_metrics",
    f"""SELECT *, {_RISK} AS risk, greatest(0, least(100, floor(100 - 25 * critical - 10 * high - 5 * medium - low - 5 * greatest(0, total / 4.0 - 2) + 0.5)))::DOUBLE AS score FROM ({_BY_USER})""",
)
def security_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by severity, risk and score; a user stands for a project of four files, with its events as findings."""
    counts = R.severity_counts(_events(spark, sf_dir), "user_id")
    c = [F.col(s) for s in R.SEVERITIES]
    return counts.withColumns({"risk": R.risk(*c), "score": R.security_score(*c, F.lit(4)).cast("double")})


@query(
    "most_common_type",
    """SELECT user_id, type, n FROM (SELECT user_id, event_type AS type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS turn FROM events GROUP BY 1, 2) WHERE turn = 1""",
)
def most_common_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode, the first seen of equals."""
    per = _events(spark, sf_dir).groupBy("user_id", "type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return per.groupBy("user_id").agg(F.max_by(F.struct("type", "n"), F.struct("n", (-F.col("first")).alias("f"))).alias("x")).select("user_id", "x.type", "x.n")


_IMPORT = r"""(?:from\s+|require\(|import\s+)["']([^"']+)["']"""
_SPEC = "unnest(regexp_extract_all(content, '" + _sql_pattern(_IMPORT) + "', 1))"
_PACKAGE = "CASE WHEN starts_with(s, '@') THEN array_to_string(string_split(s, '/')[1:2], '/') ELSE string_split(s, '/')[1] END"
DECLARED = [("react",), ("lodash",), ("left-pad",), ("typescript",)]


@query("file_imports", f"SELECT path, s AS specifier, starts_with(s, '.') AS internal, {_PACKAGE} AS package FROM (SELECT DISTINCT path, {_SPEC} AS s FROM {_FILES})")
def file_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark).select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_IMPORT), F.lit(1)))).alias("specifier"))
    return rows.select("path", "specifier", P.is_internal(F.col("specifier")).alias("internal"), P.package_name(F.col("specifier")).alias("package"))


@query(
    "package_audit",
    f"""WITH used AS (SELECT DISTINCT {_PACKAGE} AS name FROM (SELECT {_SPEC} AS s FROM {_FILES}) WHERE NOT starts_with(s, '.')), declared AS (SELECT name FROM {values(DECLARED, "name")})
    SELECT name, 'missing' AS problem FROM used WHERE name NOT IN (SELECT name FROM declared) AND name NOT IN ('fs', 'path', 'http') UNION ALL
    SELECT name, 'unused' FROM declared WHERE name NOT IN (SELECT name FROM used) AND name NOT IN ('typescript', 'eslint', 'prettier')""",
)
def package_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared less used and used less declared, but for built-in modules and development tools."""
    used = file_imports(spark, sf_dir).where("not internal").select(F.col("package").alias("name")).distinct()
    declared = spark.createDataFrame(DECLARED, "name string")
    missing = used.join(declared, "name", "left_anti").where(~F.col("name").isin("fs", "path", "http")).withColumn("problem", F.lit("missing"))
    return missing.union(declared.join(used, "name", "left_anti").where(~F.col("name").isin("typescript", "eslint", "prettier")).withColumn("problem", F.lit("unused")))


_TARGETS = f"SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host, {_NORMAL} AS path FROM (SELECT url, {_LINK_NORMAL} AS x FROM ({_LINKS}) WHERE href LIKE '/%')"


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """host and path of what links lead to, and of the pages that are there."""
    pages, host = table(spark, sf_dir, "pages"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")
    links = H.links(pages).where(F.col("href").startswith("/")).select(host, P.normal_link(F.col("href")).alias("path")).distinct()
    return links, pages.select(host, P.url_path(F.col("url")).alias("path")).distinct()


@query("missing_packages", f"WITH t AS ({_TARGETS}), p AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, {_PATH} AS path FROM pages) SELECT host, path FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.host = t.host AND p.path = t.path)")
def missing_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is used but not declared: links to pages of their host that aren't there."""
    used, declared = _linked(spark, sf_dir)
    return used.join(declared, ["host", "path"], "left_anti")


@query("unused_packages", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unused_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is declared but not used: documents that no label is about."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


#: Environment files: path, content (fixture).
ENVS = [(".env", "API_KEY=abc=1\n# comment\nPORT=3000\nNEXT_PUBLIC_URL=http://x\n\nnothing\n"), (".env.local", "DB_PASSWORD = secret\n#X=1\nDEBUG=\n")]
_SENSITIVE = r"(?i)(key|secret|token|password|private|auth|credential)"


@query(
    "environment_variables",
    f"""SELECT path, trim(split_part(line, '=', 1)) AS name, regexp_matches(trim(split_part(line, '=', 1)), '{_SENSITIVE}') AS sensitive FROM (SELECT path, unnest(string_split(content, chr(10))) AS line FROM {values(ENVS, "path, content")})
    WHERE contains(line, '=') AND NOT starts_with(trim(line), '#')""",
)
def environment_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame(ENVS, "path string, content string").select("path", F.explode(F.split("content", "\n")).alias("line"))
    name = F.btrim(F.substring_index("line", "=", 1))
    return lines.where(F.col("line").contains("=") & ~F.btrim("line").startswith("#")).select("path", name.alias("name"), name.rlike(_SENSITIVE).alias("sensitive"))


#: Translations: file, key, value; and keys used in code: key, component (fixtures).
ENTRIES = [
    ("en.json", "home.title", "Welcome"), ("en.json", "home.text", "Hello there"), ("en.json", "menu.open", "Open menu"), ("en.json", "nav.open", "Open menu"), ("en.json", "old.gone", "Nobody asks"),
    ("de.json", "home.title", "Willkommen"), ("de.json", "menu.open", "Menü öffnen"), ("de.json", "yes", "Ja"),
]
USED = [("home.title", "Home"), ("home.text", "Home"), ("menu.open", "Menu"), ("nav.open", "Nav"), ("menu.open", "Nav"), ("cart.empty", "Cart")]
_ENTRIES, _USED = values(ENTRIES, "file, key, value"), values(USED, "key, component")


def _i18n(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(ENTRIES, "file string, key string, value string"), spark.createDataFrame(USED, "key string, component string")


@query(
    "translation_missing",
    f"""SELECT k.key, f.file FROM (SELECT DISTINCT key FROM {_USED}) k, (SELECT DISTINCT file FROM {_ENTRIES}) f WHERE NOT EXISTS (SELECT 1 FROM (SELECT file, key FROM {_ENTRIES}) e WHERE e.file = f.file AND e.key = k.key)""",
)
def translation_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Used keys by file that lack them; the files are a handful, so each key carries their list."""
    entries, used = _i18n(spark)
    files = entries.agg(F.collect_set("file").alias("files"))
    wanted = used.select("key").distinct().join(F.broadcast(files)).select("key", F.explode("files").alias("file"))
    return wanted.join(entries.select("key", "file"), ["key", "file"], "left_anti")


@query(
    "translation_coverage",
    f"""SELECT file, count(*) AS keys, count_if(u.key IS NOT NULL) AS used, count_if(u.key IS NULL) AS unused, floor(100.0 * count_if(u.key IS NOT NULL) / count(*) + 0.5)::BIGINT AS coverage
    FROM (SELECT * FROM {_ENTRIES}) e LEFT JOIN (SELECT DISTINCT key FROM {_USED}) u ON e.key = u.key GROUP BY file""",
)
def translation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, used = _i18n(spark)
    known = used.select("key").distinct().withColumn("hit", F.lit(1))
    rows = entries.join(known, "key", "left")
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("keys"), F.count("hit").alias("used"), (F.count(F.lit(1)) - F.count("hit")).alias("unused"),
        round_half_up(100.0 * F.count("hit") / F.count(F.lit(1))).cast("long").alias("coverage"),
    )


@query(
    "translation_duplicates",
    f"""SELECT value, count(DISTINCT e.key) AS keys, count(DISTINCT u.component) AS components FROM (SELECT * FROM {_ENTRIES} WHERE length(value) >= 5) e JOIN (SELECT * FROM {_USED}) u ON e.key = u.key GROUP BY value HAVING count(DISTINCT e.key) > 1""",
)
def translation_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, used = _i18n(spark)
    rows = entries.where(F.length("value") >= 5).join(used, "key")
    return rows.groupBy("value").agg(F.countDistinct("key").alias("keys"), F.countDistinct("component").alias("components")).where("keys > 1")


@query("json_flatten_keys", "SELECT key, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT unnest(json_keys(props)) AS key, props ->> '$.k' AS value FROM events) GROUP BY key")
def json_flatten_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.from_json("props", "map<string,string>")
    rows = table(spark, sf_dir, "events").select(F.explode(flat).alias("key", "value"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


@query("value_duplicates", "SELECT props ->> '$.k' AS value, count(DISTINCT event_type) AS keys, count(*) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def value_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("value"))
    return rows.groupBy("value").agg(F.countDistinct("event_type").alias("keys"), F.count(F.lit(1)).alias("n")).where("keys > 1")


@query(
    "coverage_unused_missing",
    """SELECT count(*) AS documents, count(l.doc_id) AS labelled, count_if(l.doc_id IS NULL) AS missing, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS unused,
    floor(100.0 * count(l.doc_id) / count(*) + 0.5)::BIGINT AS coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def coverage_unused_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both anti joins at once, from one full outer join by id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("d"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l"))
    both = docs.join(labels, "doc_id", "full")
    hit = F.count_if(F.col("d").isNotNull() & F.col("l").isNotNull())
    return both.agg(
        F.count("d").alias("documents"), hit.alias("labelled"), F.count_if(F.col("d").isNotNull() & F.col("l").isNull()).alias("missing"),
        F.count_if(F.col("d").isNull()).alias("unused"), round_half_up(100.0 * hit / F.count("d")).cast("long").alias("coverage"),
    )


@query(
    "turn_order_rule",
    "SELECT conv_id, turn, role, CASE WHEN previous IS NULL THEN 'starts-wrong' ELSE 'repeated-role' END AS problem FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations) WHERE (previous IS NULL AND role <> 'user') OR role = previous",
)
def turn_order_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order rule over the row before: the first turn is a user's, and roles alternate."""
    t = table(spark, sf_dir, "conversations").withColumn("previous", F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")))
    first = F.col("previous").isNull()
    return t.where((first & (F.col("role") != "user")) | (F.col("role") == F.col("previous"))).select("conv_id", "turn", "role", F.when(first, "starts-wrong").otherwise("repeated-role").alias("problem"))
