"""What a scan says about files by their path and text alone: patterns to read, kinds of files, routes, middleware, configuration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths as P

# What is read, and by which words a file is known.
ROOT_FILES = (
    "next.config.ts", "next.config.js", "next.config.mjs", "tailwind.config.ts", "tailwind.config.js", "tailwind.config.mjs", "package.json", ".env", ".env.local", ".env.development", ".env.production",
    "tsconfig.json", "eslint.config.ts", "eslint.config.js", ".eslintrc.js", ".eslintrc.json", "middleware.ts", "middleware.js", "instrumentation.ts", "instrumentation.js",
)
WORDS = {
    "has_auth": ("auth", "login", "logout", "session", "token", "jwt", "oauth", "passport", "clerk", "nextauth"),
    "has_crypto": ("crypto", "encrypt", "decrypt", "hash", "bcrypt", "scrypt", "pbkdf2", "aes", "rsa"),
    "has_database": ("prisma", "mongoose", "sequelize", "knex", "sql", "query", "database"),
}
EXACT_WORDS = {
    "has_files": ("fs.", "readFile", "writeFile", "path.join", "path.resolve"), "has_calls": ("fetch(", "axios", "request(", "http.", "https."), "has_environment": ("process.env", "dotenv", ".env"),
}
DANGEROUS = ("eval(", "dangerouslySetInnerHTML", "innerHTML", "document.write")
QUICK = (
    ("hardcoded_secret", "critical", r"(?i)(?:password|secret|key|token)\s*[:=]\s*[\"'][\w\-+/=]{8,}[\"']"), ("dangerous_function", "high", r"(?i)eval\s*\("), ("unsafe_html", "medium", r"(?i)dangerouslySetInnerHTML"),
    ("weak_crypto", "medium", r"(?i)Math\.random\(\)"), ("insecure_storage", "low", r"(?i)localStorage\.(?:setItem|getItem)"), ("info_disclosure", "low", r"(?i)console\.(?:log|warn|error)"),
)
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")
INPUTS = ("body", "query", "params", "headers", "cookies")
ROUTER_FILES = {"app": ("layout", "page", "loading", "error", "not-found", "template", "default"), "pages": ("_app", "_document", "_error", "404", "500")}
PAGE_FOLDERS = r"(^|/)(pages|app|views|screens|routes)/"
UI_FOLDERS = r"(^|/)(components|ui|widgets|elements|atoms|molecules|organisms|layouts|shared|common)/"
UI_NAMES = r"(?i)^(button|card|modal|dialog|input|form|table|list|item|icon|avatar|badge|tooltip|dropdown|menu|tabs?|accordion|alert|toast|spinner|loader|skeleton|header|footer|sidebar|navbar|nav)s?$"


def patterns(framework: str, has_src: bool, router: str) -> list[tuple[str, str]]:
    """(group, glob) of what a scan reads: root files, sources, and files that bear on security, by the kind of project."""
    code, plain = "{ts,tsx,js,jsx}", "{ts,js}"
    shared = ("components", "lib", "utils", "hooks", "context", "store")
    if framework == "next" and has_src:
        source = [f"src/**/*.{code}"] + [f"src/{d}/**/*.{code}" for d in ("app", "pages", *shared)]
        security = [f"src/app/**/api/**/*.{plain}", f"src/pages/api/**/*.{plain}", f"src/app/**/auth/**/*.{code}", f"src/auth/**/*.{code}", f"src/config/**/*.{plain}", f"src/security/**/*.{code}", f"src/**/*auth*.{code}", f"src/**/*middleware*.{plain}", f"src/**/*config*.{plain}"]
    elif framework == "next":
        own = "app" if router == "app" else "pages"
        source = [f"{d}/**/*.{code}" for d in (own, *shared, "types")]
        security = [f"app/**/api/**/*.{plain}" if own == "app" else f"pages/api/**/*.{plain}", f"{own}/**/auth/**/*.{code}", f"auth/**/*.{code}", f"config/**/*.{plain}", f"security/**/*.{code}", f"**/*auth*.{code}", f"**/*middleware*.{plain}", f"**/*config*.{plain}"]
    else:
        folders = ("components", "pages", "views", *shared[1:])
        source = [f"src/**/*.{code}"] + [f"src/{d}/**/*.{code}" for d in folders] if has_src else [f"{d}/**/*.{code}" for d in folders] + [f"**/*.{code}"]
        security = [f"**/auth/**/*.{code}", f"**/config/**/*.{plain}", f"**/security/**/*.{code}", f"**/*auth*.{code}", f"**/*config*.{plain}"]
    return [("root", g) for g in ROOT_FILES] + [("source", g) for g in source] + [("security", g) for g in security]


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression on the whole path: ** any folders, * within one, {a,b} either."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "{":
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, glob[i + 1 : end].split(","))) + ")", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def selected(files: DataFrame, globs: list[tuple[str, str]]) -> DataFrame:
    """files with ``groups``: those that a glob of them names, each once."""
    hit = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.col("path").rlike(glob_pattern(g)), F.lit(group)) for group, g in globs)))))
    return files.withColumn("groups", hit).where("size(groups) > 0")


def _any(column: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, w: a | column.contains(w), words, F.lit(False))


def flags(files: DataFrame) -> DataFrame:
    """path, eight flags, n_components, has_jsx, risk: one projection over files(path, content)."""
    c, low = F.col("content"), F.lower("content")
    own = {k: _any(low, w) for k, w in WORDS.items()} | {k: _any(c, w) for k, w in EXACT_WORDS.items()}
    own["has_routes"] = c.contains("export") & _any(c, METHODS[:4])
    rows = files.select("path", "content", *(v.alias(k) for k, v in own.items()))
    some = reduce(lambda a, k: a | F.col(k), own, F.lit(False))
    middle = sum((F.col(k).cast("int") for k in ("has_auth", "has_crypto", "has_routes", "has_database")), F.lit(0))
    risk = F.when(_any(F.col("content"), DANGEROUS), "high").when(middle >= 2, "medium").when(some, "low").otherwise("none")
    counts = sum((F.regexp_count("content", F.lit(p)) for p in (r"export\s+default\s+function\s+[A-Z]", r"export\s+function\s+[A-Z]", r"const\s+[A-Z][a-zA-Z]*\s*=\s*\(", r"function\s+[A-Z][a-zA-Z]*\s*\(")), F.lit(0))
    jsx = F.col("content").contains("<") & F.col("path").rlike(r"\.(tsx|jsx)$")
    return rows.select("path", *own, some.alias("has_security"), F.greatest(F.lit(1), counts).alias("n_components"), jsx.alias("has_jsx"), risk.alias("risk"))


def file_kind(path: Column, content: Column) -> Column:
    """The kind of a file for a security scan, tried in order."""
    name, folder = P.basename(path), P.dirname(path)
    return (
        F.when(F.concat(F.lit("/"), path).contains("/api/"), "api_route").when(name.contains("middleware"), "middleware").when(name.isin("next.config.js", "next.config.ts", "tailwind.config.js", "eslint.config.js"), "config")
        .when(name.startswith(".env"), "environment").when(_any(content, ("auth", "login", "session")), "provider").when(name.rlike("util|helper") | folder.rlike("utils|helpers"), "utility")
        .when(name.rlike(r"^use.*\.tsx?$"), "hook").when(name.contains("service") | folder.contains("services"), "service").when(name.contains("constant") | folder.contains("constants"), "constant")
        .when(name.rlike(r"\.(test|spec)\.") | folder.contains("__tests__"), "test").when(name.rlike(r"\.(tsx|jsx)$"), "component").when(name.endswith(".d.ts") | name.contains("types"), "type_definition").otherwise("utility")
    )


def quick_findings(files: DataFrame) -> DataFrame:
    """path, kind, severity, n of six quick rules."""
    hit = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.regexp_count("content", F.lit(p)).alias("n")) for k, s, p in QUICK))
    return files.select("path", F.explode(hit).alias("x")).select("path", "x.kind", "x.severity", "x.n").where("n > 0")


def overall_risk(found: DataFrame) -> DataFrame:
    """One row: the worst severity of all findings, low if there are none."""
    has = lambda s: F.coalesce(F.max(F.col("severity") == s), F.lit(False))
    return found.agg(F.when(has("critical"), "critical").when(has("high"), "high").when(has("medium"), "medium").otherwise("low").alias("risk"))


def api_routes(files: DataFrame) -> DataFrame:
    """path, route, methods, handlers, inputs, has_auth, has_validation, uses_database, calls_out, handles_errors of files below api/."""
    c = F.col("content")
    own = files.where(F.col("path").rlike(r"(^|/)api/.*\.(ts|js|tsx|jsx)$"))
    route = F.regexp_replace(F.regexp_extract(F.concat(F.lit("/"), "path"), r"/api(/.*)$", 1), r"\.(ts|js|tsx|jsx)$", "")
    methods = F.array_compact(F.array(*(F.when(c.contains(f"export async function {m}") | c.contains(f"export function {m}"), F.lit(m)) for m in METHODS)))
    inputs = F.array_compact(F.array(*(F.when(c.contains(f"request.{x}") | c.contains(f"req.{x}"), F.lit(x)) for x in INPUTS)))
    return own.select(
        "path", route.alias("route"), methods.alias("methods"), F.regexp_extract_all(c, F.lit(r"export\s+(?:async\s+)?function\s+(\w+)"), F.lit(1)).alias("handlers"), inputs.alias("inputs"), _any(c, ("auth", "token")).alias("has_auth"),
        _any(c, ("validate", "schema")).alias("has_validation"), _any(c, ("prisma", "db.", "query")).alias("uses_database"), _any(c, ("fetch", "axios")).alias("calls_out"), (c.contains("try") & c.contains("catch")).alias("handles_errors"),
    )


def middleware(files: DataFrame) -> DataFrame:
    """path, kind, functions, packages, matchers, redirects, rewrites, sets_headers, reads_cookies, locales of middleware files."""
    c = F.col("content")
    own = files.where(P.basename(F.col("path")).rlike(r"^middleware\.[jt]s$"))
    kind = F.when(_any(c, ("auth", "login")), "auth").when(c.contains("cors"), "cors").when(_any(c, ("helmet", "security")), "security").when(c.contains("log"), "logging").when(c.contains("validate"), "validation").otherwise("custom")
    functions = F.array_compact(F.array(*(F.when(c.contains(w), F.lit(w)) for w in ("authenticate", "authorize", "validate", "sanitize", "rateLimit"))))
    block = F.regexp_extract(c, r"matcher\s*:\s*(\[[^\]]*\]|['\"`][^'\"`]*['\"`])", 1)
    return own.select(
        "path", kind.alias("kind"), functions.alias("functions"), F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit(r"from\s+['\"]([^'\"]+)['\"]"), F.lit(1))), lambda x: ~x.rlike("^[./]")).alias("packages"),
        F.regexp_extract_all(block, F.lit(r"['\"`]([^'\"`]+)['\"`]"), F.lit(1)).alias("matchers"), F.regexp_count(c, F.lit(r"(?:NextResponse|Response)\.redirect\s*\(")).alias("redirects"), F.regexp_count(c, F.lit(r"NextResponse\.rewrite\s*\(")).alias("rewrites"),
        c.rlike(r"headers\.set\s*\(").alias("sets_headers"), c.rlike(r"cookies\.get\s*\(").alias("reads_cookies"), c.rlike(r"(?i)\blocales?\b|i18n|next-intl").alias("has_locales"),
    )


def config_kind(path: Column) -> Column:
    name = P.basename(path)
    return (
        F.when(name.startswith("next.config"), "next_config").when(name == "package.json", "package_json").when(name.startswith("tsconfig"), "tsconfig").when(name.contains("eslint"), "eslint_config").when(name.startswith(".env"), "env_config")
        .when(name.contains("docker"), "docker_config").when(name.contains("vercel"), "vercel_config").when(name.contains("webpack"), "webpack_config").when(name.contains("babel"), "babel_config").when(name.contains("tailwind"), "tailwind_config")
        .when(name.contains("jest"), "jest_config").otherwise("next_config")
    )


def environment_kind(path: Column) -> Column:
    name = P.basename(path)
    return F.when(name.contains(".dev"), "development").when(name.contains(".prod"), "production").when(name.contains(".test"), "test").otherwise("unknown")


def outside(files: DataFrame) -> DataFrame:
    """path, packages, variables, addresses: what a file takes from outside, each name once."""
    c = F.col("content")
    return files.select(
        "path", F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit(r"from\s+['\"]([^'\"]+)['\"]"), F.lit(1))), lambda x: ~x.rlike("^[./]")).alias("packages"),
        F.array_distinct(F.regexp_extract_all(c, F.lit(r"process\.env\.(\w+)"), F.lit(1))).alias("variables"), F.array_distinct(F.regexp_extract_all(c, F.lit(r"https?://[^\s'\"]+"), F.lit(0))).alias("addresses"),
    )


CONFIG_FILES = r"(^|/)([^/]*\.config\.(js|ts|mjs|cjs)|\.[^/]*rc(\.(js|json|cjs))?|tsconfig[^/]*\.json)$"


def config_packages(files: DataFrame) -> DataFrame:
    """package, paths: packages that configuration files import, require or list by name."""
    c = F.col("content")
    found = F.array_union(
        F.array_union(F.regexp_extract_all(c, F.lit(r"(?:from|import)\s+['\"]([^'\"./][^'\"]*)['\"]"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"require\(\s*['\"]([^'\"./][^'\"]*)['\"]\s*\)"), F.lit(1))),
        F.regexp_extract_all(c, F.lit(r"(?:extends|plugins|presets)[\"']?\s*:\s*\[?\s*['\"]([^'\"./][^'\"]*)['\"]"), F.lit(1)),
    )
    rows = files.where(F.col("path").rlike(CONFIG_FILES)).select("path", F.explode(found).alias("specifier"))
    return rows.select(P.package_name(F.col("specifier")).alias("package"), "path").groupBy("package").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def treated_as_component(path: Column, framework: str = "next", router: str = "app") -> Column:
    """Whether a path alone says component: a file of the router, or markup in a file with a capital or among components."""
    name = P.stem(path)
    special = (F.lower(name) if router == "app" else name).isin(*ROUTER_FILES.get(router, ())) if framework == "next" else F.lit(False)
    return special | (path.rlike(r"\.(tsx|jsx)$") & (name.rlike("^[A-Z]") | path.contains("component")))


def page_or_part(path: Column) -> Column:
    """page, component or other, by folder, name and the router's file names."""
    name = P.stem(path)
    page = path.rlike(r"(^|/)app/(.*/)?page\.[jt]sx?$") | (path.rlike(r"(^|/)pages/") & ~path.rlike(r"(^|/)pages/api/") & ~name.startswith("_"))
    return F.when(page, "page").when(path.rlike(UI_FOLDERS) | name.rlike(UI_NAMES) | (path.rlike(r"\.(tsx|jsx)$") & name.rlike("^[A-Z]")), "component").otherwise("other")


def routes_kept(route: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether a route passes: named by a pattern to include, if there are any, and by none to exclude."""
    hit = lambda ps: reduce(lambda a, p: a | route.rlike(p), ps, F.lit(False))
    return (hit(include) if include else F.lit(True)) & ~hit(exclude)


def scanned_at(df: DataFrame) -> DataFrame:
    """df with the time of the scan."""
    return df.withColumn("scanned_at", F.current_timestamp())


def listing(spark: SparkSession, framework: str, has_src: bool, router: str) -> DataFrame:
    rows = patterns(framework, has_src, router)
    return spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(rows)], "place int, group string, glob string")
