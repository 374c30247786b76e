"""Detectors: what turns rule matches and syntax into findings. Files get a context, matches are kept or dropped by it and by the lines
around them, confidence is adjusted, and findings get an id and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.operators import findings as R

# What a file's context, a finding's neighbourhood and a module's name are judged by.
TEST_WORDS = (
    "describe(", "it(", "test(", "expect(", "assert(", "beforeEach(", "afterEach(", "beforeAll(", "afterAll(", "suite(", "setup(", "teardown(", "context(",
    "jest.", "jasmine.", "mocha.", "chai.", "sinon.", "enzyme.", "cypress.", "playwright.", "puppeteer.",
    ".toBe(", ".toEqual(", ".toHaveBeenCalled(", ".toHaveBeenCalledWith(", ".toContain(", ".toMatch(", ".toThrow(", ".toBeNull(", ".toBeTruthy(", ".toBeFalsy(", ".toBeUndefined(",
    ".mock", ".spy", ".stub", ".fake", ".restore", "render(", "shallow(", "mount(", "fireEvent.", "screen.", "userEvent.", "waitFor(", "act(",
)
SANITIZERS = ("DOMPurify", "dompurify", "sanitize-html", "xss", "js-xss", "isomorphic-dompurify", "html-sanitizer", "helmet", "express-validator", "validator")
CONFIG_FILES = (
    "next.config.js", "next.config.ts", "tailwind.config.js", "tailwind.config.ts", "webpack.config.js", "webpack.config.ts", "vite.config.js", "vite.config.ts",
    "tsconfig.json", "package.json", ".eslintrc.js", ".eslintrc.json", "babel.config.js", "jest.config.js",
)
RISK_CONTEXTS = {
    "authentication": r"(?i)login|logout|signin|signout|authenticate|session|cookie|token|jwt",
    "authorization": r"(?i)authorize|permission|role|access|acl|rbac|guard|protect",
    "data-processing": r"(?i)JSON\.parse|JSON\.stringify|serialize|deserialize|validate|sanitize|transform",
    "external-communication": r"(?i)fetch|axios|http|api|request|webhook|graphql|rest",
    "configuration": r"(?i)config|settings|environment|env|dotenv",
    "client-side": r"(?i)window\.|document\.|localStorage|sessionStorage|location\.|navigator\.",
    "server-side": r"(?i)process\.|require\(|import.*node:|fs\.|path\.|os\.",
}
SENSITIVE_DATA = r"(?i)password|secret|token|api[_-]?key|private[_-]?key|credit[_-]?card|ssn|social[_-]?security|personal[_-]?data|pii|encrypt|decrypt|hash|bcrypt|jwt"
NETWORK = r"fetch\s*\(|axios\.|http\.|https\.|XMLHttpRequest|(?i:websocket)|socket\.io|request\s*\(|got\s*\(|superagent|node-fetch"
AUTH_LIBRARIES = {
    "next-auth": r"(?i)next-auth", "auth0": r"(?i)@auth0", "clerk": r"(?i)clerk", "passport": r"(?i)passport", "jsonwebtoken": r"(?i)jsonwebtoken", "jwt-decode": r"(?i)jwt-decode",
    "bcrypt": r"(?i)bcrypt", "argon2": r"(?i)argon2", "scrypt": r"(?i)scrypt", "firebase-auth": r"(?i)firebase.*auth", "supabase-auth": r"(?i)supabase.*auth",
}
SQL_LIBRARIES = ("mysql", "mysql2", "pg", "postgres", "sqlite3", "better-sqlite3", "prisma", "sequelize", "typeorm", "knex", "drizzle-orm", "mongodb", "mongoose", "database", "db-migrate", "node-sql-parser")
SQL_KEYWORDS = (
    "SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "UNION", "WHERE", "ORDER BY", "GROUP BY", "HAVING", "JOIN", "INNER JOIN", "LEFT JOIN", "RIGHT JOIN", "FULL JOIN",
    "FROM", "INTO", "VALUES", "SET", "LIMIT", "OFFSET",
)
SQL_METHODS = ("query", "execute", "exec", "run", "all", "get", "prepare", "raw", "sql", "findRaw", "executeRaw")
RAW_METHODS = ("raw", "query", "execute", "exec", "sql", "findRaw", "executeRaw", "$queryRaw", "$executeRaw", "$queryRawUnsafe", "$executeRawUnsafe")
SAFE_METHODS = (
    "findMany", "findFirst", "findUnique", "create", "update", "delete", "upsert", "count", "aggregate", "findAll", "findOne", "findByPk", "findAndCountAll", "destroy", "bulkCreate", "bulkUpdate",
    "find", "findOneBy", "save", "remove", "softRemove", "recover", "insert",
)
DATABASE_NAMES = ("pool", "db", "connection", "client", "database")
INPUTS = (
    "req.query", "req.params", "req.body", "request.query", "request.params", "request.body", "searchparams", "formdata", "input", "userinput", "query", "params", "filter", "search", "sort",
    "orderby", "where", "condition",
)
SQL_VARIABLES = ("sql", "query", "sqlquery", "statement", "sqlstatement", "command", "sqlcommand", "rawquery", "selectquery", "insertquery", "updatequery", "deletequery")
UI_VARIABLES = ("component", "hook", "render", "get", "handle", "on", "use", "icon", "button", "form", "input", "modal", "page", "layout")
PARAMETERS = r"prisma\.\w+\.(?:findMany|findFirst|findUnique|create|update|delete|upsert|count|aggregate)|\?|\$\d+|:[\w_]+|@[\w_]+"
BUILTINS = (
    "fs", "path", "os", "crypto", "buffer", "stream", "http", "https", "net", "url", "util", "child_process", "cluster", "dgram", "dns", "events", "readline", "repl", "tls", "vm", "zlib",
    "worker_threads", "perf_hooks", "inspector", "async_hooks", "trace_events", "v8", "domain", "punycode", "querystring", "string_decoder", "timers",
)
SERVER_LIBRARIES = (
    "mysql", "mysql2", "postgres", "pg", "mongodb", "mongoose", "prisma", "sequelize", "typeorm", "knex", "sqlite", "sqlite3", "redis", "ioredis", "cassandra-driver", "neo4j-driver",
    "bcrypt", "bcryptjs", "argon2", "scrypt", "pbkdf2", "jsonwebtoken", "passport", "passport-local", "passport-jwt", "express-session",
    "express", "koa", "fastify", "hapi", "restify", "connect", "cors", "helmet", "morgan", "compression", "cookie-parser",
    "multer", "formidable", "archiver", "tar", "yauzl", "yazl", "chokidar", "nodemon", "pm2", "forever",
    "shelljs", "execa", "cross-spawn", "which", "find-up", "graceful-fs", "rimraf", "mkdirp", "glob", "minimatch",
    "node-forge", "crypto-js", "tweetnacl", "sodium-native", "nodemailer", "sendgrid", "mailgun", "twilio", "stripe", "paypal-rest-sdk", "braintree",
    "aws-sdk", "@aws-sdk", "google-cloud", "azure",
    "webpack", "rollup", "vite", "esbuild", "babel", "typescript", "eslint", "prettier", "jest", "mocha", "chai", "sinon",
)
#: Server libraries that hand out data or secrets where they reach a client.
CRITICAL_LIBRARIES = SERVER_LIBRARIES[:26]
MAYBE_LIBRARIES = ("axios", "node-fetch", "undici", "got", "superagent", "request", "dotenv", "config", "winston", "bunyan", "pino")
SERVER_PATHS = ("/api/", "/pages/api/", "/app/api/", "/server/", "/lib/server/", "/utils/server/", "middleware.ts", "middleware.js", "/prisma/", "/database/", "/db/", "next.config", ".env")
EXCLUDED = r"node_modules|dist|build|\.git|coverage"
EXCLUDED_TESTS = EXCLUDED + r"|__tests__|\.test\.|\.spec\."
#: Types whose rules skip tests altogether, and types that only client code can have.
WITHOUT_TESTS = ("sql-injection", "client-storage-sensitive", "unvalidated-redirect", "insecure-cookie")
CLIENT_ONLY = ("environment-exposure", "client-storage-sensitive")
SAFE_ENVIRONMENT = r"process\.env\.(NEXT_PUBLIC_\w+|REACT_APP_\w+|VITE_\w+|NODE_ENV)$"
HEADER_FILES = r"next\.config\.(js|ts|mjs)$"
DEPLOYMENT_FILES = ("vercel.json", "netlify.toml", "nginx.conf", "_headers", "Dockerfile")


def _any(column: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, w: a | column.contains(w), words, F.lit(False))


def _slashed(path: Column) -> Column:
    return F.concat(F.lit("/"), F.regexp_replace(path, "^/", ""))


def file_context(files: DataFrame) -> DataFrame:
    """path, file_type, risk_contexts, sensitive, client, network, auth_libraries, variables: one projection over files(path, content)."""
    path, name, c = _slashed(F.col("path")), P.basename(F.col("path")), F.coalesce("content", F.lit(""))
    component = (c.rlike(r"from\s+['\"]react['\"]") & (c.rlike("<[A-Z]") | c.rlike("(?i)jsx"))) | path.rlike(r"\.(tsx|jsx)$")
    file_type = (
        F.when(path.contains("/api/"), "api-route")
        .when(name.isin("middleware.ts", "middleware.js") | path.contains("/middleware/"), "middleware")
        .when(name.isin(*CONFIG_FILES), "config")
        .when(name.startswith(".env"), "environment")
        .when(path.rlike(r"\.(test|spec)\.(ts|tsx|js|jsx)$|__tests__|/tests?/"), "test")
        .when(component, "component")
        .when(path.rlike("/(utils|lib|helpers)/"), "utility")
        .otherwise("unknown")
    )
    contexts = F.array_compact(F.array(*(F.when(c.rlike(p) | ((F.lit(k) == "configuration") & (F.col("file_type") == "config")), F.lit(k)) for k, p in RISK_CONTEXTS.items())))
    client = path.rlike("/(components|pages|app|src|public)/") | (F.col("file_type") == "component") | ~(path.rlike("/(api|server)/") | F.col("file_type").isin("middleware", "config"))
    return files.select("path", "content", file_type.alias("file_type")).select(
        "path", "file_type", F.when(F.size(contexts) > 0, contexts).otherwise(F.array(F.lit("none"))).alias("risk_contexts"), c.rlike(SENSITIVE_DATA).alias("sensitive"), client.alias("client"),
        c.rlike(NETWORK).alias("network"), F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(k)) for k, p in AUTH_LIBRARIES.items()))).alias("auth_libraries"),
        F.array_distinct(F.regexp_extract_all(c, F.lit(r"process\.env\.(\w+)"), F.lit(1))).alias("variables"),
    )


def relevant(path: Column, kind: Column) -> Column:
    """Whether a type's rules look at a file at all, by its path."""
    supported = path.rlike(r"\.(ts|tsx|js|jsx)$")
    return supported & ~path.rlike(EXCLUDED) & ~(kind.isin(*WITHOUT_TESTS) & path.rlike(EXCLUDED_TESTS)) & ~((kind == "server-only-import") & _any(_slashed(path), SERVER_PATHS))


def has_sql(content: Column) -> Column:
    """Names of database libraries, or calls that hold statements."""
    called = content.rlike(rf"(?i)(?:query|execute|exec|sql)\s*\([^)]*(?:{'|'.join(SQL_KEYWORDS)})")
    return _any(content, SQL_LIBRARIES) | called | _any(content, ("pool.query", "db.query", "connection.query"))


def in_comment(context: Column, code: Column) -> Column:
    """Whether a line of the context that holds the code is a comment."""
    return F.exists(F.split(context, "\n"), lambda line: line.contains(code) & F.btrim(line).rlike(r"^(//|\*)"))


def in_test(context: Column) -> Column:
    return _any(context, TEST_WORDS)


def shifted(confidence: Column, steps: Column) -> Column:
    """A confidence some steps up (or down, if negative), at most high and at least low."""
    at = F.least(F.lit(3), F.greatest(F.lit(1), F.array_position(F.array(*map(F.lit, ("low", "medium", "high"))), confidence) + steps))
    return F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), at.cast("int"))


def component_name(path: Column) -> Column:
    """The file's name without its extension, if it starts with a capital; else null."""
    name = F.regexp_replace(P.basename(path), r"\.(tsx?|jsx?)$", "")
    return F.when(name.rlike("^[A-Z]"), name)


def function_name(context: Column) -> Column:
    """The first name that the context shows, by four forms tried in turn; else null."""
    forms = (r"function\s+(\w+)", r"const\s+(\w+)\s*=", r"(\w+)\s*:\s*\(", r"(\w+)\s*\(")
    return F.coalesce(*(F.nullif(F.regexp_extract(context, p, 1), F.lit("")) for p in forms))


def judge(matches: DataFrame) -> DataFrame:
    """Findings of matches that carry their file's facts: path, rule, type, severity, confidence, code, line, column, context (the line
    and its neighbours), file_type, risk_contexts, client, sql, sanitizers. Drops what isn't relevant, commented out, or test code;
    lowers confidence beside sanitizers and in tests, raises it where identities are handled; adds id, component and function."""
    kind, c = F.col("type"), F.col
    kept = (
        relevant(c("path"), kind)
        & ~((kind == "sql-injection") & ~c("sql"))
        & ~(kind.isin(*CLIENT_ONLY) & (~c("client") | c("file_type").isin("api-route", "middleware")))
        & ~((kind == "environment-exposure") & c("code").rlike(SAFE_ENVIRONMENT))
        & ~((kind == "server-only-import") & c("context").contains("import type"))
        & ~in_comment(c("context"), c("code"))
        & ~(kind.isin("sql-injection") & in_test(c("context")))
        & ~((kind == "unsafe-innerhtml") & c("sanitizers") & c("context").rlike(r"(?i)sanitize|purify"))
    )
    valid = (c("path") != "") & (c("line") >= 1) & (c("column") >= 1) & (F.btrim(c("code")) != "")
    base = F.when((kind == "unsafe-innerhtml") & c("sanitizers"), "medium").otherwise(c("confidence"))
    trusted = F.arrays_overlap("risk_contexts", F.array(F.lit("authentication"), F.lit("authorization")))
    # One step at a time, each within the scale.
    lowered = shifted(base, F.when(c("file_type") == "test", -1).otherwise(0))
    confidence = F.when(kind == "server-only-import", c("confidence")).otherwise(shifted(lowered, F.when(trusted, 1).otherwise(0)))
    return matches.where(kept & valid).select(
        R.finding_id(c("path"), c("line"), c("column"), kind).alias("id"), "path", "rule", "type", "severity", confidence.alias("confidence"), "code", "line", "column",
        component_name(c("path")).alias("component"), function_name(c("context")).alias("function"),
    )


def matches_with_facts(files: DataFrame, rules: tuple[R.Rule, ...] = R.RULES) -> DataFrame:
    """Rule matches of files(path, content) with what ``judge`` needs: the lines around them and facts of their file."""
    facts = file_context(files).select("path", "file_type", "risk_contexts", "client")
    lines = files.select("path", F.split("content", "\n", -1).alias("lines"), has_sql(F.col("content")).alias("sql"), _any(F.col("content"), SANITIZERS).alias("sanitizers"))
    found = R.match_rules(files, rules).join(lines, "path").join(facts, "path")
    around = F.array_join(F.slice("lines", F.greatest(F.lit(1), F.col("line") - 1).cast("int"), F.when(F.col("line") > 1, 3).otherwise(2)), "\n")
    return found.withColumn("context", around).drop("lines")


def sql_calls(nodes: DataFrame) -> DataFrame:
    """Findings of calls that run statements with what a user may have sent among their arguments, of templates with both, and of
    variables put together from such parts: path, rule, type, severity, confidence, code, line, column."""
    calls = nodes.where("kind = 'Call'").withColumns({"method": F.substring_index("name", ".", -1), "object": F.regexp_replace("name", r"\.?[^.]*$", "")})
    aimed = (F.col("object") == "") & F.col("method").isin(*SQL_METHODS) | ((F.col("object") != "") & F.col("method").isin(*SQL_METHODS, *RAW_METHODS) & (_any(F.lower("object"), DATABASE_NAMES) | F.col("object").contains(".")))
    calls = calls.where(aimed & ~F.col("method").isin(*SAFE_METHODS)).select("path", F.col("node_id").alias("parent_id"), "method", "name", "line", "col", "exit")
    read = nodes.where("kind in ('Identifier', 'Member')").select("path", "parent_id", "node_id", F.coalesce("name", "text").alias("source"))
    templates = nodes.where("kind = 'Template'").select("path", "node_id", "parent_id", F.col("text").alias("template"), "line", "col")
    sent = read.where(_any(F.lower("source"), INPUTS))
    direct = sent.select("path", "parent_id", "source")
    inside = sent.join(templates.select("path", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("call")), ["path", "parent_id"]).select("path", F.col("call").alias("parent_id"), "source")
    hits = calls.join(direct.union(inside), ["path", "parent_id"]).groupBy("path", "parent_id", "method", "name", "line", "col").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    sure = F.when(F.exists("sources", lambda x: x.rlike(r"(?i)req\.|request\.|query|params|body")), "high").otherwise("medium")
    bound = templates.select("path", "parent_id", "template").groupBy("path", "parent_id").agg(F.max(F.col("template").rlike(PARAMETERS)).alias("bound"))
    hits = hits.join(bound, ["path", "parent_id"], "left")
    found = hits.select(
        "path", F.lit("sql-call").alias("rule"), F.when(F.col("method").isin(*RAW_METHODS), "critical").otherwise("high").alias("severity"),
        F.when(F.coalesce("bound", F.lit(False)), "low").otherwise(sure).alias("confidence"), F.concat("name", F.lit("("), F.array_join("sources", ", "), F.lit(")")).alias("code"), "line", "col",
    )
    with_words = templates.where(_any(F.upper("template"), SQL_KEYWORDS) & F.col("template").contains("${"))
    spans = sent.select("path", F.col("parent_id").alias("node_id")).distinct()
    written = with_words.join(spans, ["path", "node_id"], "left_semi").select("path", F.lit("sql-template").alias("rule"), F.lit("critical").alias("severity"), F.lit("high").alias("confidence"), F.col("template").alias("code"), "line", "col")
    low = F.lower("name")
    vars_ = nodes.where("kind = 'Variable'").where(~F.col("name").rlike("^[A-Z][a-zA-Z0-9]*$") & ~_any(low, UI_VARIABLES))
    held = with_words.select("path", F.col("parent_id").alias("node_id"), F.col("template").alias("code")).dropDuplicates(["path", "node_id"])
    named = vars_.where(_any(low, SQL_VARIABLES)).select("path", "node_id", "line", "col").join(held, ["path", "node_id"])
    made = named.select("path", F.lit("sql-variable").alias("rule"), F.lit("high").alias("severity"), F.lit("medium").alias("confidence"), "code", "line", "col")
    return found.unionByName(written).unionByName(made).select("path", "rule", F.lit("sql-injection").alias("type"), "severity", "confidence", "code", "line", F.col("col").alias("column"))


def _library(module: Column, libraries: tuple[str, ...]) -> Column:
    """Whether a module is one of the libraries, or a part of one."""
    return F.concat_ws("/", F.slice(F.split(module, "/"), 1, F.when(module.startswith("@"), 2).otherwise(1))).isin(*libraries) | F.split(module, "/")[0].isin(*libraries)


def server_imports(imports: DataFrame) -> DataFrame:
    """path, specifier, line, category, severity, confidence: modules in client code that only a server has. imports(path, specifier,
    line, is_type)."""
    m = F.col("specifier")
    path = _slashed(F.col("path"))
    client = ~_any(path, SERVER_PATHS) & path.rlike(r"\.(ts|tsx|js|jsx)$")
    category = (
        F.when(m.isin(*BUILTINS), "nodejs-builtin").when(_library(m, CRITICAL_LIBRARIES), "sensitive-server-library").when(_library(m, SERVER_LIBRARIES), "server-only-library")
        .when(_library(m, MAYBE_LIBRARIES), "potentially-server-only")
    )
    typed = (m == "typescript") & path.rlike(r"\.d\.ts$|/types/")
    rows = imports.where(client & ~F.col("is_type") & ~typed).withColumn("category", category).where("category is not null")
    maybe = F.col("category") == "potentially-server-only"
    severity = F.when(F.col("category") == "sensitive-server-library", "critical").when(maybe, "medium").otherwise("high")
    return rows.select("path", "specifier", "line", "category", severity.alias("severity"), F.when(maybe, "medium").otherwise("high").alias("confidence"))


def configured_headers(files: DataFrame) -> DataFrame:
    """path, header, value, weak: security headers that a framework's configuration file sets, by its key and value pairs."""
    own = files.where(F.col("path").rlike(HEADER_FILES))
    pairs = F.regexp_extract_all("content", F.lit(r"key\s*:\s*['\"]([^'\"]+)['\"]\s*,\s*value\s*:\s*['\"`]([^\"`]*?)['\"`]\s*[,}]"), F.lit(0))
    each = own.select("path", F.explode(pairs).alias("pair"))
    rows = each.select("path", F.regexp_extract("pair", r"key\s*:\s*['\"]([^'\"]+)['\"]", 1).alias("header"), F.regexp_extract("pair", r"value\s*:\s*['\"`]([^\"`]*?)['\"`]\s*[,}]", 1).alias("value"))
    h, v = F.lower("header"), F.lower("value")
    weak = ((h == "x-frame-options") & (v == "allowall")) | ((h == "content-security-policy") & v.rlike("unsafe-(inline|eval)")) | ((h == "referrer-policy") & (v == "unsafe-url"))
    return rows.withColumn("weak", weak | ((h == "strict-transport-security") & v.rlike(r"max-age=0\b")))


def header_findings(files: DataFrame) -> DataFrame:
    """path, header, severity, problem: headers that the configuration lacks (low where a deployment file may set them), or sets weakly.
    A project of the framework without a configuration lacks all of them."""
    from quarry.operators.audits import HEADERS

    elsewhere = files.agg(F.coalesce(F.max(_any(F.col("path"), DEPLOYMENT_FILES)), F.lit(False)).alias("elsewhere"))
    uses = F.col("path").rlike("(^|/)package\\.json$") & F.col("content").contains('"next"')
    place = files.agg(F.max(F.when(F.col("path").rlike(HEADER_FILES), F.col("path"))).alias("config"), F.coalesce(F.max(uses), F.lit(False)).alias("uses"))
    target = place.where("config is not null or uses").select(F.coalesce("config", F.lit("next.config.js")).alias("path"))
    needed = target.select("path", F.explode(F.array(*(F.struct(F.lit(h).alias("header"), F.lit(s).alias("severity")) for h, s in HEADERS))).alias("x")).select("path", "x.header", "x.severity")
    have = configured_headers(files)
    missing = needed.join(have.select("path", F.lower("header").alias("low")), (needed["path"] == have["path"]) & (F.lower(needed["header"]) == F.col("low")), "left_anti")
    # One row says whether anything deploys the project.
    missing = missing.join(F.broadcast(elsewhere)).select("path", "header", F.when(F.col("elsewhere"), "low").otherwise(F.col("severity")).alias("severity"), F.lit("missing").alias("problem"))
    return missing.union(have.where("weak").select("path", "header", F.lit("medium"), F.lit("weak")))


def by_priority(findings: DataFrame) -> DataFrame:
    """Sorted by severity, confidence, path, line, and then column and rule."""
    at = lambda c, names: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    return findings.orderBy(at("severity", R.SEVERITIES), at("confidence", R.CONFIDENCES), "path", "line", "column", "rule")


def project_rollup(findings: DataFrame, routes: DataFrame, packages: DataFrame) -> DataFrame:
    """One row: routes and those with findings, authentication and validation; whether headers and variables are safe; packages."""
    f = findings.agg(
        F.count_if(F.col("path").contains("/api/")).alias("route_findings"), (F.count_if(F.col("type") == "missing-security-headers") == 0).alias("headers_configured"),
        (F.count_if(F.col("type") == "environment-exposure") == 0).alias("variables_safe"), F.count_if(F.col("type").isin("insecure-random", "dangerous-eval")).alias("risky_uses"),
    )
    r = routes.agg(F.count(F.lit(1)).alias("routes"), F.count_if("has_auth").alias("authenticated"), F.count_if("has_validation").alias("validated"))
    # Each side is one row.
    return r.join(F.broadcast(f)).join(F.broadcast(packages.agg(F.count(F.lit(1)).alias("packages"))))


def detect(files: DataFrame, nodes: DataFrame | None = None, rules: tuple[R.Rule, ...] = R.RULES) -> DataFrame:
    """All findings: of rules, and, where the syntax is given, of statements and imports; one a place and type, the surest first."""
    found = judge(matches_with_facts(files, rules))
    if nodes is not None:
        calls = sql_calls(nodes)
        typed = nodes.where("kind = 'TypeOnly'").select("path", F.col("parent_id").alias("node_id"), F.lit(True).alias("is_type"))
        own = nodes.where("kind = 'Import'").join(typed, ["path", "node_id"], "left")
        imports = server_imports(own.select("path", F.col("name").alias("specifier"), "line", F.coalesce("is_type", F.lit(False)).alias("is_type")))
        more = calls.select("path", "rule", "type", "severity", "confidence", "code", "line", "column").unionByName(
            imports.select("path", F.col("category").alias("rule"), F.lit("server-only-import").alias("type"), "severity", "confidence", F.col("specifier").alias("code"), "line", F.lit(1).alias("column"))
        )
        more = more.withColumns({"id": R.finding_id(F.col("path"), F.col("line"), F.col("column"), F.col("type")), "component": component_name(F.col("path")), "function": F.lit(None).cast("string")})
        found = found.unionByName(more.select(found.columns))
    return R.deduplicated(found, "path", "line", "column", "type", seq="rule")
