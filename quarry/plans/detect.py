"""Detectors over literal files, matches and imports, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import findings as R
from quarry.operators import security as S
from quarry.plans.common import named, node_table, table, values
from quarry.registry import query
from quarry.sources import syntax


def _list(words: tuple[str, ...] | list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _has(column: str, words: tuple[str, ...]) -> str:
    return f"(len(list_filter({_list(words)}, lambda w: contains({column}, w))) > 0)"


CONTEXTS = [
    ("app/api/users/route.ts", "import jwt from 'jsonwebtoken';\nexport async function GET() { return process.env.DB_URL + process.env.DB_URL; }\n"),
    ("middleware.ts", "export function middleware(request) { return fetch('/x'); }\n"),
    ("next.config.js", "module.exports = {};\n"),
    (".env", "A=1\n"),
    ("src/a.test.ts", "test('x', () => { expect(1).toBe(1); });\n"),
    ("src/components/Card.tsx", "export const Card = () => <div onClick={() => window.open('/')} />;\n"),
    ("lib/util/dates.ts", "export const add = (a, b) => a + b;\n"),
    ("src/utils/hash.ts", "import bcrypt from 'bcrypt';\nexport const p = password => bcrypt.hash(password);\n"),
    ("src/x.ts", "import React from 'react';\nconst A = <B />;\n"),
    ("server/db.ts", "const pool = require('pg'); axios.get('/r');\n"),
]
_TYPE = f"""CASE WHEN contains(p, '/api/') THEN 'api-route' WHEN base IN ('middleware.ts', 'middleware.js') OR contains(p, '/middleware/') THEN 'middleware' WHEN list_contains({_list(S.CONFIG_FILES)}, base) THEN 'config'
    WHEN starts_with(base, '.env') THEN 'environment' WHEN regexp_matches(p, '\\.(test|spec)\\.(ts|tsx|js|jsx)$|__tests__|/tests?/') THEN 'test'
    WHEN (regexp_matches(content, 'from\\s+[''"]react[''"]') AND (regexp_matches(content, '<[A-Z]') OR regexp_matches(content, '(?i)jsx'))) OR regexp_matches(p, '\\.(tsx|jsx)$') THEN 'component'
    WHEN regexp_matches(p, '/(utils|lib|helpers)/') THEN 'utility' ELSE 'unknown' END"""
_RISKS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(content, '{p}')" + (" OR file_type = 'config'" if k == "configuration" else "") + f" THEN '{k}' END" for k, p in S.RISK_CONTEXTS.items()) + "], lambda x: x IS NOT NULL)"
_AUTH = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(content, '{p}') THEN '{k}' END" for k, p in S.AUTH_LIBRARIES.items()) + "], lambda x: x IS NOT NULL)"


@query(
    "file_contexts",
    f"""WITH {named("f", CONTEXTS, "path, content")}, g AS (SELECT *, '/' || path AS p, regexp_extract(path, '[^/]*$') AS base FROM f), h AS (SELECT *, {_TYPE} AS file_type FROM g)
    SELECT path, file_type, CASE WHEN len({_RISKS}) = 0 THEN 'none' ELSE array_to_string({_RISKS}, ',') END AS risks, regexp_matches(content, '{S.SENSITIVE_DATA}') AS sensitive,
    regexp_matches(p, '/(components|pages|app|src|public)/') OR file_type = 'component' OR NOT (regexp_matches(p, '/(api|server)/') OR file_type IN ('middleware', 'config')) AS client,
    regexp_matches(content, '{S.NETWORK}') AS network, array_to_string({_AUTH}, ',') AS libraries, len(list_distinct(regexp_extract_all(content, 'process\\.env\\.(\\w+)', 1))) AS n_variables FROM h""",
)
def file_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.file_context(spark.createDataFrame(CONTEXTS, "path string, content string"))
    return c.select("path", "file_type", F.array_join("risk_contexts", ",").alias("risks"), "sensitive", "client", "network", F.array_join("auth_libraries", ",").alias("libraries"), F.size("variables").cast("long").alias("n_variables"))


#: Matches with facts of their file: path, rule, type, severity, confidence, code, line, column, context, file_type, risks, client, sql, sanitizers.
MATCHES = [
    ("src/a.ts", "sql-string-concatenation", "sql-injection", "critical", "high", "'SELECT' +", 3, 9, "function load(id) {\n  return db.query('SELECT' + id);\n}", "unknown", "none", True, True, False),
    ("src/b.ts", "sql-string-concatenation", "sql-injection", "critical", "high", "'SELECT' +", 3, 9, "x\n// db.query('SELECT' + id)\ny", "unknown", "none", True, True, False),
    ("src/c.ts", "sql-string-concatenation", "sql-injection", "critical", "high", "'FROM' +", 1, 4, "it('x', () => {\n'FROM' + a", "unknown", "none", True, True, False),
    ("src/d.ts", "sql-string-concatenation", "sql-injection", "critical", "high", "'FROM' +", 1, 4, "'FROM' + a", "unknown", "none", True, False, False),
    ("src/e.test.ts", "sql-string-concatenation", "sql-injection", "critical", "high", "'FROM' +", 1, 4, "'FROM' + a", "test", "none", True, True, False),
    ("src/Html.tsx", "inner-html", "unsafe-innerhtml", "critical", "high", ".innerHTML =", 5, 2, "const draw = () => {\n  el.innerHTML = x;\n}", "component", "none", True, False, True),
    ("src/Html2.tsx", "inner-html", "unsafe-innerhtml", "critical", "high", ".innerHTML =", 5, 2, "el.innerHTML = DOMPurify.sanitize(x);", "component", "none", True, False, True),
    ("src/h.test.tsx", "inner-html", "unsafe-innerhtml", "critical", "high", ".innerHTML =", 5, 2, "el.innerHTML = x;", "test", "none", True, False, False),
    ("src/Login.tsx", "math-random", "insecure-random", "high", "medium", "Math.random()", 2, 11, "\n  make: (n) => Math.random(),\n", "component", "authentication,client-side", True, False, False),
    ("src/api/x.ts", "process-env", "environment-exposure", "high", "medium", "process.env.SECRET", 2, 1, "a\nprocess.env.SECRET\nb", "api-route", "none", True, False, False),
    ("src/env.ts", "process-env", "environment-exposure", "high", "medium", "process.env.SECRET", 2, 1, "a\nprocess.env.SECRET\nb", "unknown", "none", True, False, False),
    ("src/env.ts", "process-env", "environment-exposure", "high", "medium", "process.env.NEXT_PUBLIC_A", 3, 1, "process.env.NEXT_PUBLIC_A", "unknown", "none", True, False, False),
    ("lib/s.ts", "process-env", "environment-exposure", "high", "medium", "process.env.SECRET", 2, 1, "process.env.SECRET", "unknown", "none", False, False, False),
    ("src/fs.ts", "nodejs-builtin-import", "server-only-import", "high", "high", "import 'fs'", 1, 1, "import 'fs'", "test", "authentication", True, False, False),
    ("src/fs2.ts", "nodejs-builtin-import", "server-only-import", "high", "high", "import x from 'fs'", 1, 1, "import type x from 'fs'", "unknown", "none", True, False, False),
    ("server/fs.ts", "nodejs-builtin-import", "server-only-import", "high", "high", "import 'fs'", 1, 1, "import 'fs'", "unknown", "none", False, False, False),
    ("dist/a.js", "direct-eval", "dangerous-eval", "critical", "high", "eval(", 1, 1, "eval(x)", "unknown", "none", True, False, False),
    ("src/z.ts", "direct-eval", "dangerous-eval", "critical", "high", "eval(", 0, 1, "eval(x)", "unknown", "none", True, False, False),
    ("src/blank.ts", "direct-eval", "dangerous-eval", "critical", "low", " ", 1, 1, "x", "test", "authorization", True, False, False),
    ("src/low.test.ts", "indexed-db", "client-storage-sensitive", "medium", "low", "indexedDB.", 1, 1, "indexedDB.open()", "test", "none", True, False, False),
    ("src/keep.test.ts", "indexed-db", "debug-code", "medium", "low", "debugger", 1, 1, "debugger", "test", "none", True, False, False),
    ("src/up.ts", "local-storage", "client-storage-sensitive", "medium", "high", "localStorage.getItem('token')", 4, 3, "localStorage.getItem('token')", "unknown", "authorization", True, False, False),
]
_MATCH = "path, rule, type, severity, confidence, code, line, col, context, file_type, risks, client, sql, sanitizers"
_STEP = "CASE {0} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_EXCLUDED = "'" + S.EXCLUDED + "'"


def _judged() -> str:
    comment = "len(list_filter(string_split(context, chr(10)), lambda l: contains(l, code) AND regexp_matches(trim(l), '^(//|\\*)'))) > 0"
    keep = f"""regexp_matches(path, '\\.(ts|tsx|js|jsx)$') AND NOT regexp_matches(path, {_EXCLUDED}) AND NOT (type IN ({', '.join(repr(t) for t in S.WITHOUT_TESTS)}) AND regexp_matches(path, '__tests__|\\.test\\.|\\.spec\\.'))
        AND NOT (type = 'server-only-import' AND {_has("'/' || path", S.SERVER_PATHS)}) AND (type <> 'sql-injection' OR sql) AND NOT (type IN ({', '.join(repr(t) for t in S.CLIENT_ONLY)}) AND (NOT client OR file_type IN ('api-route', 'middleware')))
        AND NOT (type = 'environment-exposure' AND regexp_matches(code, '{S.SAFE_ENVIRONMENT}')) AND NOT (type = 'server-only-import' AND contains(context, 'import type')) AND NOT ({comment})
        AND NOT (type = 'sql-injection' AND {_has('context', S.TEST_WORDS)}) AND NOT (type = 'unsafe-innerhtml' AND sanitizers AND regexp_matches(context, '(?i)sanitize|purify')) AND path <> '' AND line >= 1 AND col >= 1 AND trim(code) <> ''"""
    base = "CASE WHEN type = 'unsafe-innerhtml' AND sanitizers THEN 'medium' ELSE confidence END"
    low = f"greatest(1, {_STEP.format('(' + base + ')')} - CASE WHEN file_type = 'test' THEN 1 ELSE 0 END)"
    up = f"least(3, {low} + CASE WHEN regexp_matches(risks, 'authentication|authorization') THEN 1 ELSE 0 END)"
    names = ["function\\s+(\\w+)", "const\\s+(\\w+)\\s*=", "(\\w+)\\s*:\\s*\\(", "(\\w+)\\s*\\("]
    function = "coalesce(" + ", ".join(f"nullif(regexp_extract(context, '{p}', 1), '')" for p in names) + ")"
    return f"""SELECT left(sha256(path || ':' || line || ':' || col || ':' || type), 16) AS id, path, rule, type, severity, CASE WHEN type = 'server-only-import' THEN confidence ELSE ['low', 'medium', 'high'][{up}] END AS confidence, code, line, col AS "column",
        CASE WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '^[A-Z]') THEN regexp_replace(regexp_extract(path, '[^/]*$'), '\\.(tsx?|jsx?)$', '') END AS component, {function} AS function FROM m WHERE {keep}"""


@query("judged_findings", f"WITH {named('m', MATCHES, _MATCH)} {_judged()}")
def judged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of matches: relevance, comments, tests, sanitizers, confidence, names."""
    kinds = "path string, rule string, type string, severity string, confidence string, code string, line int, column int, context string, file_type string, risks string, client boolean, sql boolean, sanitizers boolean"
    rows = spark.createDataFrame(MATCHES, kinds).withColumn("risk_contexts", F.split("risks", ","))
    return S.judge(rows)


SOURCES = [
    ("src/db/load.ts", "export async function GET(req) {\n  const sql = `SELECT * FROM t WHERE id=${req.query.id}`;\n  await db.query(sql, req.body);\n  pool.execute(`UPDATE t SET a=${params}`);\n  client.findMany(req.query);\n  list.get(filter);\n  return db.raw(name);\n}\n"),
    ("src/Page.tsx", "import fs from 'fs';\nimport { x } from '@/lib/x';\nimport type { Pool } from 'pg';\nimport { z } from 'zod';\nimport y from 'pg/lib/y';\nimport l from 'pino';\nconst PageQuery = `SELECT ${input}`;\nel.innerHTML = x;\n"),
    ("src/api/route.ts", "import fs from 'fs';\n"),
]


def _sources(spark: SparkSession) -> DataFrame:
    return syntax.nodes(spark.createDataFrame(SOURCES, "path string, content string"))


_INPUT = _has("lower(name)", S.INPUTS)
_SQL_CALLS = f"""{node_table(SOURCES)}, ids AS (SELECT path, parent_id, name AS source FROM n WHERE kind = 'Identifier' AND {_INPUT}), tpl AS (SELECT path, node_id, parent_id, text, line, col FROM n WHERE kind = 'Template'),
calls AS (SELECT path, node_id, name, line, col, regexp_extract(name, '[^.]*$') AS method, regexp_replace(name, '\\.?[^.]*$', '') AS object FROM n WHERE kind = 'Call'),
aimed AS (SELECT * FROM calls WHERE NOT list_contains({_list(S.SAFE_METHODS)}, method) AND ((object = '' AND list_contains({_list(S.SQL_METHODS)}, method)) OR (object <> '' AND list_contains({_list(S.SQL_METHODS + S.RAW_METHODS)}, method) AND ({_has('lower(object)', S.DATABASE_NAMES)} OR contains(object, '.'))))),
sent AS (SELECT c.path, c.node_id, i.source FROM aimed c JOIN ids i ON i.path = c.path AND i.parent_id = c.node_id UNION SELECT c.path, c.node_id, i.source FROM aimed c JOIN tpl t ON t.path = c.path AND t.parent_id = c.node_id JOIN ids i ON i.path = t.path AND i.parent_id = t.node_id),
hits AS (SELECT path, node_id, list_sort(list(source)) AS s FROM sent GROUP BY 1, 2), bound AS (SELECT path, parent_id, bool_or(regexp_matches(text, '{S.PARAMETERS}')) AS b FROM tpl GROUP BY 1, 2),
worded AS (SELECT * FROM tpl WHERE {_has('upper(text)', S.SQL_KEYWORDS)} AND contains(text, '${{'))"""


@query(
    "sql_call_findings",
    f"""WITH {_SQL_CALLS} SELECT h.path, 'sql-call' AS rule, CASE WHEN list_contains({_list(S.RAW_METHODS)}, c.method) THEN 'critical' ELSE 'high' END AS severity,
    CASE WHEN coalesce(b.b, false) THEN 'low' WHEN regexp_matches(array_to_string(s, ' '), '(?i)req\\.|request\\.|query|params|body') THEN 'high' ELSE 'medium' END AS confidence, c.name || '(' || array_to_string(s, ', ') || ')' AS code, c.line
    FROM hits h JOIN calls c USING (path, node_id) LEFT JOIN bound b ON b.path = h.path AND b.parent_id = h.node_id
    UNION ALL SELECT path, 'sql-template', 'critical', 'high', text, line FROM worded w WHERE EXISTS (SELECT 1 FROM ids i WHERE i.path = w.path AND i.parent_id = w.node_id)
    UNION ALL SELECT v.path, 'sql-variable', 'high', 'medium', w.text, v.line FROM n v JOIN worded w ON w.path = v.path AND w.parent_id = v.node_id WHERE v.kind = 'Variable' AND NOT regexp_matches(v.name, '^[A-Z][a-zA-Z0-9]*$') AND NOT {_has('lower(v.name)', S.UI_VARIABLES)} AND {_has('lower(v.name)', S.SQL_VARIABLES)}""",
)
def sql_call_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sql_calls(_sources(spark)).drop("type", "column")


IMPORTS = [("src/a.tsx", "fs", 1, False), ("src/a.tsx", "pg/lib", 2, False), ("src/a.tsx", "express", 3, False), ("src/a.tsx", "pino", 4, True), ("src/a.tsx", "axios", 5, False), ("src/a.tsx", "react", 6, False), ("server/a.ts", "fs", 1, False), ("src/types/t.d.ts", "typescript", 1, False), ("src/b.ts", "typescript", 1, False), ("src/b.ts", "@aws-sdk/client-s3", 2, False), ("src/b.css", "fs", 1, False)]


@query(
    "server_imports",
    f"""WITH {named("i", IMPORTS, "path, specifier, line, is_type")}, c AS (SELECT *, CASE WHEN list_contains({_list(S.BUILTINS)}, specifier) THEN 'nodejs-builtin' WHEN list_contains({_list(S.CRITICAL_LIBRARIES)}, split_part(specifier, '/', 1)) THEN 'sensitive-server-library'
    WHEN list_contains({_list(S.SERVER_LIBRARIES)}, split_part(specifier, '/', 1)) THEN 'server-only-library' WHEN list_contains({_list(S.MAYBE_LIBRARIES)}, split_part(specifier, '/', 1)) THEN 'potentially-server-only' END AS category FROM i
    WHERE NOT is_type AND NOT {_has("'/' || path", S.SERVER_PATHS)} AND regexp_matches(path, '\\.(ts|tsx|js|jsx)$') AND NOT (specifier = 'typescript' AND regexp_matches(path, '\\.d\\.ts$|/types/')))
    SELECT path, specifier, line, category, CASE category WHEN 'sensitive-server-library' THEN 'critical' WHEN 'potentially-server-only' THEN 'medium' ELSE 'high' END AS severity, CASE category WHEN 'potentially-server-only' THEN 'medium' ELSE 'high' END AS confidence FROM c WHERE category IS NOT NULL""",
)
def server_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.server_imports(spark.createDataFrame(IMPORTS, "path string, specifier string, line int, is_type boolean"))


HEADERS = [
    ("next.config.js", "module.exports = { async headers() { return [{ source: '/', headers: [{ key: 'X-Frame-Options', value: 'ALLOWALL' }, { key: 'strict-transport-security', value: 'max-age=63072000' }, { key: 'Content-Security-Policy', value: 'script-src unsafe-inline' }] }]; } };\n"),
    ("vercel.json", "{}"),
]


@query(
    "header_findings",
    f"""WITH f AS (SELECT * FROM {values(HEADERS, "path, content")}), p AS (SELECT path, unnest(regexp_extract_all(content, 'key\\s*:\\s*[''"]([^''"]+)[''"]\\s*,\\s*value\\s*:\\s*[''"]([^"`]*?)[''"]\\s*[,}}]', 1)) AS header, unnest(regexp_extract_all(content, 'key\\s*:\\s*[''"]([^''"]+)[''"]\\s*,\\s*value\\s*:\\s*[''"]([^"`]*?)[''"]\\s*[,}}]', 2)) AS value FROM f WHERE path = 'next.config.js')
    SELECT 'next.config.js' AS path, h AS header, 'low' AS severity, 'missing' AS problem FROM (SELECT unnest(['X-Frame-Options', 'X-Content-Type-Options', 'Referrer-Policy', 'X-XSS-Protection', 'Strict-Transport-Security', 'Content-Security-Policy', 'Permissions-Policy']) AS h) WHERE lower(h) NOT IN (SELECT lower(header) FROM p)
    UNION ALL SELECT path, header, 'medium', 'weak' FROM p WHERE (lower(header) = 'x-frame-options' AND lower(value) = 'allowall') OR (lower(header) = 'content-security-policy' AND regexp_matches(value, 'unsafe-(inline|eval)'))""",
)
def header_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.header_findings(spark.createDataFrame(HEADERS, "path string, content string"))


@query("findings_by_type", "SELECT event_type AS type, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS place FROM events")
def findings_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings of a user, numbered within their type in order of user and id."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), "user_id", F.col("event_id").alias("id"))
    return R.numbered(e, "type", F.floor(F.col("user_id") / 16), "user_id", "id").select("type", "id", "place")


_PRIORITY = "CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END, CASE WHEN value >= 150 THEN 1 WHEN value >= 75 THEN 2 ELSE 3 END, user_id, event_id"


@query("findings_by_priority", f"SELECT event_id, row_number() OVER (ORDER BY {_PRIORITY}) AS place FROM events ORDER BY {_PRIORITY} LIMIT 50")
def findings_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty findings by severity, confidence, user and id (a report's head)."""
    kind, value = F.col("event_type"), F.col("value")
    severity = F.when(kind == "error", "critical").when(kind == "purchase", "high").when(kind == "signup", "medium").otherwise("low")
    confidence = F.when(value >= 150, "high").when(value >= 75, "medium").otherwise("low")
    e = table(spark, sf_dir, "events").select("event_id", severity.alias("severity"), confidence.alias("confidence"), F.col("user_id").alias("path"), F.col("event_id").alias("line"), F.lit(1).alias("column"), F.lit("r").alias("rule"))
    top = S.by_priority(e).limit(50)
    from pyspark.sql import Window as W

    at = lambda c, names: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    order = W.orderBy(at("severity", R.SEVERITIES), at("confidence", R.CONFIDENCES), "path", "line")  # over fifty rows
    return top.select("event_id", F.row_number().over(order).cast("long").alias("place"))


ROLLUP = [("src/api/a.ts", "insecure-random"), ("src/b.ts", "environment-exposure"), ("src/pages/api/c.ts", "dangerous-eval"), ("src/d.ts", "debug-code")]
ROUTES = [("/api/a", True, False), ("/api/b", True, True), ("/api/c", False, False)]


@query(
    "security_rollup",
    f"""WITH {named("f", ROLLUP, "path, type")}, {named("r", ROUTES, "route, has_auth, has_validation")} SELECT (SELECT count(*) FROM r) AS routes, (SELECT count_if(has_auth) FROM r) AS authenticated, (SELECT count_if(has_validation) FROM r) AS validated,
    count_if(contains(path, '/api/')) AS route_findings, count_if(type = 'missing-security-headers') = 0 AS headers_configured, count_if(type = 'environment-exposure') = 0 AS variables_safe, count_if(type IN ('insecure-random', 'dangerous-eval')) AS risky_uses, 2 AS packages FROM f""",
)
def security_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = spark.createDataFrame([("next",), ("react",)], "name string")
    return S.project_rollup(spark.createDataFrame(ROLLUP, "path string, type string"), spark.createDataFrame(ROUTES, "route string, has_auth boolean, has_validation boolean"), packages).withColumn("packages", F.col("packages").cast("int"))


@query("security_findings")
def security_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors over small sources; tests hold the result against a list made by hand."""
    files = spark.createDataFrame(SOURCES, "path string, content string")
    return S.detect(files, syntax.nodes(files)).select("path", "type", "rule", "severity", "confidence", "line", "component")
