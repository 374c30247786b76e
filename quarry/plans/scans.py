"""Scans of literal files, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.common import named, table
from quarry.registry import query
from quarry.sources import scans as S

FILES = [
    ("src/app/api/users/route.ts", "import { db } from 'prisma';\nexport async function GET(request) { const q = request.query; return db.user(q); }\nexport function POST(req) { validate(req.body, schema); try { fetch('https://x.org/a'); } catch (e) {} }\nfunction auth() { return process.env.KEY; }\n"),
    ("middleware.ts", "import { NextResponse } from 'next/server';\nimport x from './x';\nexport function middleware(req) { if (!req.cookies.get('login')) return NextResponse.redirect('/a'); res.headers.set('a', 'b'); return NextResponse.rewrite('/b'); }\nexport const config = { matcher: ['/a/:path*', '/b'] };\n"),
    ("next.config.js", "const withMDX = require('@next/mdx');\nimport tw from 'tailwindcss/plugin';\nmodule.exports = { plugins: ['postcss-x'] };\n"),
    (".env.production", "A=1\n"), ("src/lib/util.ts", "export const a = fs.readFile('x');\nel.innerHTML = Math.random();\nconsole.log(a);\nconst key = \"abcdefgh1\";\n"), ("src/hooks/useThing.ts", "export function useThing() { return 1; }\n"),
    ("src/components/Card.tsx", "export default function Card() { return <p />; }\nconst Inner = () => <b />;\n"), ("src/plain.ts", "export const x = 1;\n"), ("src/app/shop/page.tsx", "export default function Page() {}\n"), ("src/types.d.ts", "type A = 1;\n"), ("src/services/mail.js", "module.exports = 1;\n"),
    ("src/constants.ts", "export const A = 1;\n"), ("src/x.test.ts", "it('x');\n"), (".eslintrc.json", '{"extends": ["airbnb"], "plugins": ["react"]}\n'), ("tsconfig.json", "{}"),
]
_FILES = named("f", FILES, "path, content")


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "path string, content string")


def _has(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_OWN = {k: _has("lower(content)", w) for k, w in S.WORDS.items()} | {k: _has("content", w) for k, w in S.EXACT_WORDS.items()} | {"has_routes": "contains(content, 'export') AND " + _has("content", S.METHODS[:4])}
_COUNT = " + ".join(f"len(regexp_extract_all(content, '{p}'))" for p in (r"export\s+default\s+function\s+[A-Z]", r"export\s+function\s+[A-Z]", r"const\s+[A-Z][a-zA-Z]*\s*=\s*\(", r"function\s+[A-Z][a-zA-Z]*\s*\("))


@query(
    "security_flags",
    f"""WITH {_FILES}, g AS (SELECT path, content, {', '.join(f'({v}) AS {k}' for k, v in _OWN.items())} FROM f) SELECT path, {', '.join(_OWN)}, {' OR '.join(_OWN)} AS has_security, greatest(1, {_COUNT})::INT AS n_components, contains(content, '<') AND regexp_matches(path, '\\.(tsx|jsx)$') AS has_jsx,
    CASE WHEN {_has('content', S.DANGEROUS)} THEN 'high' WHEN has_auth::INT + has_crypto::INT + has_routes::INT + has_database::INT >= 2 THEN 'medium' WHEN {' OR '.join(_OWN)} THEN 'low' ELSE 'none' END AS risk FROM g""",
)
def security_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flags(_files(spark))


_NAME, _DIR = "regexp_extract(path, '[^/]*$')", "regexp_replace(path, '/?[^/]*$', '')"


@query(
    "security_file_kinds",
    f"""WITH {_FILES} SELECT path, CASE WHEN contains('/' || path, '/api/') THEN 'api_route' WHEN contains({_NAME}, 'middleware') THEN 'middleware' WHEN {_NAME} IN ('next.config.js', 'next.config.ts', 'tailwind.config.js', 'eslint.config.js') THEN 'config' WHEN starts_with({_NAME}, '.env') THEN 'environment' WHEN {_has('content', ('auth', 'login', 'session'))} THEN 'provider'
    WHEN regexp_matches({_NAME}, 'util|helper') OR regexp_matches({_DIR}, 'utils|helpers') THEN 'utility' WHEN regexp_matches({_NAME}, '^use.*\\.tsx?$') THEN 'hook' WHEN contains({_NAME}, 'service') OR contains({_DIR}, 'services') THEN 'service' WHEN contains({_NAME}, 'constant') OR contains({_DIR}, 'constants') THEN 'constant' WHEN regexp_matches({_NAME}, '\\.(test|spec)\\.') THEN 'test'
    WHEN regexp_matches({_NAME}, '\\.(tsx|jsx)$') THEN 'component' WHEN ends_with({_NAME}, '.d.ts') OR contains({_NAME}, 'types') THEN 'type_definition' ELSE 'utility' END AS kind FROM f""",
)
def security_file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark).select("path", S.file_kind(F.col("path"), F.col("content")).alias("kind"))


_QUICK = " UNION ALL ".join(f"SELECT path, '{k}' AS kind, '{s}' AS severity, len(regexp_extract_all(content, '{p.replace(chr(39), chr(39) * 2)}')) AS n FROM f" for k, s, p in S.QUICK)


@query("quick_findings", f"WITH {_FILES}, q AS ({_QUICK}) SELECT path, kind, severity, n::INT AS n FROM q WHERE n > 0")
def quick_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quick_findings(_files(spark))


@query("overall_risk", f"WITH {_FILES}, q AS ({_QUICK}), g AS (SELECT * FROM q WHERE n > 0) SELECT CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'high') THEN 'high' WHEN bool_or(severity = 'medium') THEN 'medium' ELSE 'low' END AS risk FROM g")
def overall_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.overall_risk(S.quick_findings(_files(spark)))


def _found(words: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{w}' END" for w, c in words.items()) + "], lambda x: x IS NOT NULL), ',')"


@query(
    "api_routes",
    f"""WITH {_FILES} SELECT path, regexp_replace(regexp_extract('/' || path, '/api(/.*)$', 1), '\\.(ts|js|tsx|jsx)$', '') AS route, {_found({m: f"contains(content, 'export async function {m}') OR contains(content, 'export function {m}')" for m in S.METHODS})} AS methods, array_to_string(regexp_extract_all(content, 'export\\s+(?:async\\s+)?function\\s+(\\w+)', 1), ',') AS handlers,
    {_found({x: f"contains(content, 'request.{x}') OR contains(content, 'req.{x}')" for x in S.INPUTS})} AS inputs, {_has('content', ('auth', 'token'))} AS has_auth, {_has('content', ('validate', 'schema'))} AS has_validation, {_has('content', ('prisma', 'db.', 'query'))} AS uses_database, {_has('content', ('fetch', 'axios'))} AS calls_out, contains(content, 'try') AND contains(content, 'catch') AS handles_errors
    FROM f WHERE regexp_matches(path, '(^|/)api/.*\\.(ts|js|tsx|jsx)$')""",
)
def api_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.api_routes(_files(spark))
    return r.select("path", "route", *(F.array_join(c, ",").alias(c) for c in ("methods", "handlers", "inputs")), "has_auth", "has_validation", "uses_database", "calls_out", "handles_errors")


@query(
    "middleware_facts",
    f"""WITH {_FILES} SELECT path, CASE WHEN {_has('content', ('auth', 'login'))} THEN 'auth' WHEN contains(content, 'cors') THEN 'cors' WHEN {_has('content', ('helmet', 'security'))} THEN 'security' WHEN contains(content, 'log') THEN 'logging' WHEN contains(content, 'validate') THEN 'validation' ELSE 'custom' END AS kind,
    {_found({w: f"contains(content, '{w}')" for w in ('authenticate', 'authorize', 'validate', 'sanitize', 'rateLimit')})} AS functions, 'next/server' AS packages, array_to_string(regexp_extract_all(regexp_extract(content, 'matcher\\s*:\\s*(\\[[^\\]]*\\])', 1), '[''"`]([^''"`]+)[''"`]', 1), ',') AS matchers,
    len(regexp_extract_all(content, '(?:NextResponse|Response)\\.redirect\\s*\\('))::INT AS redirects, len(regexp_extract_all(content, 'NextResponse\\.rewrite\\s*\\('))::INT AS rewrites, regexp_matches(content, 'headers\\.set\\s*\\(') AS sets_headers, regexp_matches(content, 'cookies\\.get\\s*\\(') AS reads_cookies, regexp_matches(content, '(?i)\\blocales?\\b|i18n|next-intl') AS has_locales
    FROM f WHERE regexp_matches(path, '(^|/)middleware\\.[jt]s$')""",
)
def middleware_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.middleware(_files(spark))
    return m.select("path", "kind", *(F.array_join(c, ",").alias(c) for c in ("functions", "packages", "matchers")), "redirects", "rewrites", "sets_headers", "reads_cookies", "has_locales")


@query(
    "config_kinds",
    f"""WITH {_FILES} SELECT path, CASE WHEN starts_with({_NAME}, 'next.config') THEN 'next_config' WHEN {_NAME} = 'package.json' THEN 'package_json' WHEN starts_with({_NAME}, 'tsconfig') THEN 'tsconfig' WHEN contains({_NAME}, 'eslint') THEN 'eslint_config' WHEN starts_with({_NAME}, '.env') THEN 'env_config' ELSE 'next_config' END AS kind,
    CASE WHEN contains({_NAME}, '.dev') THEN 'development' WHEN contains({_NAME}, '.prod') THEN 'production' WHEN contains({_NAME}, '.test') THEN 'test' ELSE 'unknown' END AS environment FROM f WHERE regexp_matches({_NAME}, '^(next|ts|\\.e)')""",
)
def config_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _files(spark).where(F.regexp_extract("path", "[^/]*$", 0).rlike(r"^(next|ts|\.e)"))
    return own.select("path", S.config_kind(F.col("path")).alias("kind"), S.environment_kind(F.col("path")).alias("environment"))


@query(
    "outside_names",
    f"""WITH {_FILES} SELECT path, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(content, 'from\\s+[''"]([^''"]+)[''"]', 1), lambda x: NOT regexp_matches(x, '^[./]')))), ',') AS packages, array_to_string(list_sort(list_distinct(regexp_extract_all(content, 'process\\.env\\.(\\w+)', 1))), ',') AS variables,
    array_to_string(list_sort(list_distinct(regexp_extract_all(content, 'https?://[^\\s''"]+'))), ',') AS addresses FROM f""",
)
def outside_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.outside(_files(spark))
    return o.select("path", *(F.array_join(F.sort_array(c), ",").alias(c) for c in ("packages", "variables", "addresses")))


@query(
    "config_packages",
    f"""WITH {_FILES}, c AS (SELECT path, unnest(list_distinct(list_concat(list_concat(regexp_extract_all(content, '(?:from|import)\\s+[''"]([^''"./][^''"]*)[''"]', 1), regexp_extract_all(content, 'require\\(\\s*[''"]([^''"./][^''"]*)[''"]\\s*\\)', 1)), regexp_extract_all(content, '(?:extends|plugins|presets)["'']?\\s*:\\s*\\[?\\s*[''"]([^''"./][^''"]*)[''"]', 1)))) AS s FROM f WHERE regexp_matches(path, '{S.CONFIG_FILES}'))
    SELECT CASE WHEN starts_with(s, '@') THEN array_to_string(string_split(s, '/')[1:2], '/') ELSE split_part(s, '/', 1) END AS package, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM c GROUP BY 1""",
)
def config_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.config_packages(_files(spark)).select("package", F.array_join("paths", ",").alias("paths"))


@query(
    "path_roles",
    f"""WITH {_FILES}, g AS (SELECT path, regexp_replace({_NAME}, '(.)\\.[^.]*$', '\\1') AS stem FROM f) SELECT path, lower(stem) IN ('layout', 'page', 'loading', 'error', 'not-found', 'template', 'default') OR (regexp_matches(path, '\\.(tsx|jsx)$') AND (regexp_matches(stem, '^[A-Z]') OR contains(path, 'component'))) AS component,
    CASE WHEN regexp_matches(path, '(^|/)app/(.*/)?page\\.[jt]sx?$') OR (regexp_matches(path, '(^|/)pages/') AND NOT regexp_matches(path, '(^|/)pages/api/') AND NOT starts_with(stem, '_')) THEN 'page' WHEN regexp_matches(path, '{S.UI_FOLDERS}') OR regexp_matches(stem, '{S.UI_NAMES}') OR (regexp_matches(path, '\\.(tsx|jsx)$') AND regexp_matches(stem, '^[A-Z]')) THEN 'component' ELSE 'other' END AS role FROM g""",
)
def path_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _files(spark).select("path", S.treated_as_component(p).alias("component"), S.page_or_part(p).alias("role"))


#: Which of the scan's groups name each file, by reading the globs.
GROUPS = [("src/app/api/users/route.ts", "security,source"), ("middleware.ts", "root"), ("next.config.js", "root"), (".env.production", "root"), ("src/lib/util.ts", "source"), ("src/hooks/useThing.ts", "source"), ("src/components/Card.tsx", "source"), ("src/plain.ts", "source"), ("src/app/shop/page.tsx", "source"), ("src/types.d.ts", "source"), ("src/services/mail.js", "source"), ("src/constants.ts", "source"), ("src/x.test.ts", "source"), (".eslintrc.json", "root"), ("tsconfig.json", "root")]


@query("scan_groups", f"WITH {named('g', GROUPS, 'path, groups')} SELECT * FROM g")
def scan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the patterns of a project with src and an app router select."""
    return S.selected(_files(spark).select("path"), S.patterns("next", True, "app")).select("path", F.array_join("groups", ",").alias("groups"))


@query("scan_patterns")
def scan_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.listing(spark, "next", False, "pages")


@query("routes_kept", "SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS route FROM pages WHERE regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/[a-m]') AND NOT regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[0-9]$')")
def routes_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of pages that a pattern names, less those that another does."""
    r = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("route")).distinct()
    return r.where(S.routes_kept(F.col("route"), ("^/[a-m]",), ("[0-9]$",)))
