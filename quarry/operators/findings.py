"""Findings of rules over files: matching, deduplication, metrics, risk and score."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import let, line_starts, match_positions, place_in, round_half_up

SEVERITIES = ("critical", "high", "medium", "low")
CONFIDENCES = ("high", "medium", "low")


#: Extensions of code, and of code with markup.
CODE, MARKUP = (".ts", ".tsx", ".js", ".jsx"), (".tsx", ".jsx")


class Rule(NamedTuple):
    """A pattern rule. It applies to files with one of its extensions (no extensions: to all, if it is enabled)."""

    id: str
    kind: str
    pattern: str
    severity: str
    confidence: str
    extensions: tuple[str, ...] = CODE
    enabled: bool = True

    def applies(self, path: Column) -> Column:
        if not self.extensions:
            return F.lit(self.enabled)
        return F.concat(F.lit("."), F.substring_index(path, ".", -1)).isin(*self.extensions)


_SQL = r"SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|UNION|WHERE|ORDER\s+BY|GROUP\s+BY|HAVING|JOIN|FROM|INTO|VALUES|SET|LIMIT|OFFSET"
_BUILTIN = "fs|path|os|crypto|buffer|stream|http|https|net|url|util|child_process|cluster|dgram|dns|events|readline|repl|tls|vm|zlib|worker_threads"
_DATABASE = "mysql|postgres|pg|mongodb|mongoose|prisma|sequelize|typeorm|knex"
#: Pattern rules (fixed values: what counts as a finding is defined by them).
RULES = (
    Rule("direct-eval", "dangerous-eval", r"\beval\s*\(", "critical", "high"),
    Rule("function-constructor", "dangerous-eval", r"\bnew\s+Function\s*\(", "critical", "high"),
    Rule("settimeout-string", "dangerous-eval", r"setTimeout\s*\(\s*['\"`]", "critical", "medium"),
    Rule("setinterval-string", "dangerous-eval", r"setInterval\s*\(\s*['\"`]", "critical", "medium"),
    Rule("execscript", "dangerous-eval", r"\bexecScript\s*\(", "critical", "high"),
    Rule("dangerously-set-inner-html", "unsafe-innerhtml", r"dangerouslySetInnerHTML\s*:", "critical", "high"),
    Rule("inner-html", "unsafe-innerhtml", r"\.innerHTML\s*=", "critical", "medium"),
    Rule("outer-html", "unsafe-innerhtml", r"\.outerHTML\s*=", "critical", "medium"),
    Rule("document-write", "unsafe-innerhtml", r"document\.write\s*\(", "critical", "high"),
    Rule("document-writeln", "unsafe-innerhtml", r"document\.writeln\s*\(", "critical", "high"),
    Rule("console-log-password", "console-logging-sensitive", r"(?i)console\.(?:log|warn|error|info|debug)\s*\([^)]*password[^)]*\)", "critical", "high"),
    Rule("console-log-token", "console-logging-sensitive", r"(?i)console\.(?:log|warn|error|info|debug)\s*\([^)]*token[^)]*\)", "critical", "high"),
    Rule("console-log-secret", "console-logging-sensitive", r"(?i)console\.(?:log|warn|error|info|debug)\s*\([^)]*secret[^)]*\)", "critical", "high"),
    Rule("console-log-key", "console-logging-sensitive", r"(?i)console\.(?:log|warn|error|info|debug)\s*\([^)]*\b(?:api_?key|private_?key|encryption_?key)\b[^)]*\)", "critical", "medium"),
    Rule("react-create-element-script", "react-antipattern", r"React\.createElement\s*\(\s*['\"`]script['\"`]", "critical", "high"),
    Rule("jsx-script-with-variable", "react-antipattern", r"<script[^>]*>\s*\{[^}]*\}", "critical", "high", MARKUP),
    Rule("sql-template-literal", "sql-injection", rf"(?i)`[^`]*\$\{{[^}}]*\}}[^`]*(?:{_SQL})", "critical", "high"),
    Rule("sql-string-concatenation", "sql-injection", rf"(?i)['\"][^'\"]*(?:{_SQL})[^'\"]*['\"]\s*\+", "critical", "high"),
    Rule("raw-sql-with-variables", "sql-injection", r"(?i)(?:query|execute|exec|raw|sql)\s*\(\s*[^)]*\$\{|(?:query|execute|exec|raw|sql)\s*\(\s*[^)]*\+", "high", "medium"),
    Rule("math-random", "insecure-random", r"Math\.random\s*\(\s*\)", "high", "medium"),
    Rule("date-now", "insecure-random", r"Date\.now\s*\(\s*\)\s*%", "high", "medium"),
    Rule("http-url", "mixed-content", r"['\"`]http://[^'\"`\s]+['\"`]", "high", "medium"),
    Rule("http-api-call", "mixed-content", r"fetch\s*\(\s*['\"`]http://[^'\"`\s]+['\"`]", "high", "high"),
    Rule("http-axios-call", "mixed-content", r"axios\.[a-z]+\s*\(\s*['\"`]http://[^'\"`\s]+['\"`]", "high", "high"),
    Rule("http-image-src", "mixed-content", r"(?i)src\s*=\s*['\"`]http://[^'\"`\s]+\.(?:jpg|jpeg|png|gif|svg|webp)['\"`]", "high", "high", MARKUP),
    Rule("http-script-src", "mixed-content", r"(?i)src\s*=\s*['\"`]http://[^'\"`\s]+\.js['\"`]", "high", "high", MARKUP),
    Rule("process-env", "environment-exposure", r"process\.env\.\w+", "high", "medium"),
    Rule("server-env-in-client", "environment-exposure", r"process\.env\.(?:DATABASE_URL|DB_PASSWORD|SECRET_KEY|PRIVATE_KEY|API_SECRET)", "high", "high"),
    Rule("debugger", "debug-code", r"\bdebugger\s*;?", "high", "high"),
    Rule("debug-flag", "debug-code", r"(?:debug|DEBUG|isDebug|debugMode|isDev|devMode)\s*[:=]\s*true", "high", "medium"),
    Rule("console-debug", "debug-code", r"console\.(?:debug|trace|group|groupCollapsed|groupEnd|time|timeEnd|profile|profileEnd)", "high", "medium"),
    Rule("development-only", "debug-code", r"if\s*\(\s*(?:process\.env\.NODE_ENV\s*===?\s*['\"]development['\"]|isDev|isDebug|debugMode)\s*\)", "high", "low"),
    Rule("nested-quantifier", "redos-vulnerability", r"\([^)]*\+[^)]*\)\+|\([^)]*\*[^)]*\)\*|\([^)]*\+[^)]*\)\{", "high", "high"),
    Rule("grouped-quantifiers", "redos-vulnerability", r"\([^)]*[\+\*]\)[^)]*[\+\*]|\([^)]*\{[^}]*\}[^)]*\)[^)]*[\+\*]", "medium", "medium"),
    Rule("nodejs-builtin-import", "server-only-import", rf"import.*['\"](?:{_BUILTIN})['\"]|require\(['\"](?:{_BUILTIN})['\"]\)", "high", "high"),
    Rule("database-import-client", "server-only-import", rf"import.*['\"](?:{_DATABASE})['\"]|require\(['\"](?:{_DATABASE})['\"]\)", "critical", "high"),
    Rule("document-cookie", "insecure-cookie", r"document\.cookie\s*=", "medium", "medium"),
    Rule("cookie-without-secure", "insecure-cookie", r"document\.cookie\s*=\s*[^;]*(?!.*[Ss]ecure)", "medium", "medium"),
    Rule("cookie-without-httponly", "insecure-cookie", r"document\.cookie\s*=\s*[^;]*(?!.*[Hh]ttp[Oo]nly)", "medium", "medium"),
    Rule("cookie-without-samesite", "insecure-cookie", r"document\.cookie\s*=\s*[^;]*(?!.*[Ss]ame[Ss]ite)", "medium", "medium"),
    Rule("local-storage", "client-storage-sensitive", r"(?i)localStorage\.(?:setItem|getItem)\s*\([^)]*(?:password|token|secret|key|auth|jwt|session)[^)]*", "medium", "high"),
    Rule("session-storage", "client-storage-sensitive", r"(?i)sessionStorage\.(?:setItem|getItem)\s*\([^)]*(?:password|token|secret|key|auth|jwt|session)[^)]*", "medium", "high"),
    Rule("indexed-db", "client-storage-sensitive", r"(?i)indexedDB\.|IDBDatabase", "medium", "low"),
    Rule("router-push", "unvalidated-redirect", r"(?i)router\.push\s*\(\s*[^)]*(?:query|params|searchParams|req\.|request\.)", "medium", "medium"),
    Rule("window-location", "unvalidated-redirect", r"(?i)window\.location\s*=\s*[^;]*(?:query|params|searchParams|req\.|request\.)", "medium", "medium"),
    Rule("redirect-function", "unvalidated-redirect", r"(?i)redirect\s*\(\s*[^)]*(?:query|params|searchParams|req\.|request\.)", "medium", "medium"),
    Rule("hardcoded-secret", "hardcoded-secret", r"(?i)(?:api_?key|secret|password|token)\s*[:=]\s*['\"][^'\"]{8,}['\"]", "critical", "high"),
)


def _position(severity: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), severity)


def match_rules(files: DataFrame, rules: tuple[Rule, ...] = RULES, most: int | None = None, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """A finding for each match of each rule in files(path, content): rules are literals inside of one projection, so the files are
    read once and nothing is joined; places come from what stands between matches, lines and columns from a search among the starts of
    lines. ``most`` keeps the first so many of a rule and file, where a report wants no more; by default every match is a finding."""

    def hits(r: Rule) -> Column:
        none = F.array().cast("array<struct<code:string,index:int>>")
        every = F.when(r.applies(F.col("path")), match_positions(F.col("content"), r.pattern)).otherwise(none)
        found = every if most is None else F.slice(every, 1, most)
        return F.transform(found, lambda m: F.struct(F.lit(r.id).alias("rule"), F.lit(r.kind).alias("type"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"), m["code"].alias("code"), m["index"].alias("index")))

    every = F.flatten(F.array(*map(hits, rules)))
    placed = let(line_starts(F.col("content")), lambda starts: F.transform(every, lambda f: F.struct(f.alias("f"), place_in(starts, f["index"]).alias("at"))))
    rows = files.select(*keep, F.explode(placed).alias("x"))
    return rows.select(*keep, "x.f.rule", "x.f.type", "x.f.severity", "x.f.confidence", "x.f.code", "x.at.line", "x.at.column")


def located(texts: DataFrame, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, seq, line, column, code: all matches of a pattern in each text, in order from 0."""
    found = match_positions(F.col(text), pattern)
    placed = let(found, lambda every: F.when(F.size(every) > 0, let(line_starts(F.col(text)), lambda starts: F.transform(every, lambda m: F.struct(m["code"].alias("code"), place_in(starts, m["index"]).alias("at"))))))
    return texts.where(F.col(text).rlike(pattern)).select(*keep, F.posexplode(placed).alias("seq", "x")).select(*keep, "seq", "x.at.line", "x.at.column", "x.code")


def numbered(rows: DataFrame, by: str, bucket: Column, *order: str) -> DataFrame:
    """All columns and ``place``, from 1, within ``by`` in an order whose first column grows with the bucket: rows are numbered inside of
    a bucket, and buckets are counted, so that a frequent value of ``by`` isn't sorted by one task."""
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy(by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(by, "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(by, "_bucket").orderBy(*order))
    return rows.withColumn("_turn", inside).join(before, [by, "_bucket"]).withColumn("place", F.col("_before") + F.col("_turn")).drop("_bucket", "_before", "_turn")


def drop_commented(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Without findings whose line is a comment."""
    lines = files.select(F.col("path").alias("p"), F.split("content", "\n").alias("lines"))
    joined = findings.join(lines, findings["path"] == lines["p"])
    own = F.btrim(F.get("lines", F.col("line") - 1))
    return joined.where(~own.startswith("//") & ~own.startswith("*")).select(findings.columns)


def finding_id(path: Column, line: Column, column: Column, kind: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, line.cast("string"), column.cast("string"), kind), 256), 1, 16)


def deduplicated(findings: DataFrame, *key: str, seq: str) -> DataFrame:
    """One finding a key: the one of the highest confidence, the first of equals."""
    order = W.partitionBy(*key).orderBy(_position(F.col("confidence"), CONFIDENCES), seq)
    return findings.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn")


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES), F.count(F.lit(1)).alias("total"))


def risk(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    """The overall risk of counts by severity."""
    return (
        F.when(critical > 0, "critical").when(high > 2, "high").when((high > 0) | (medium > 5), "medium")
        .when((medium > 0) | (low > 10), "low").otherwise("none")
    )


def security_score(critical: Column, high: Column, medium: Column, low: Column, files: Column) -> Column:
    """100 less penalties by severity and for more than two findings a file, within 0 and 100."""
    density = (critical + high + medium + low) / F.greatest(files, F.lit(1))
    raw = 100 - 25 * critical - 10 * high - 5 * medium - low - 5 * F.greatest(F.lit(0.0), density - 2)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), round_half_up(raw)))
