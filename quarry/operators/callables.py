"""Functions: names with their certainty, parameters, waiting, classes of use, what they call, which to list, and what is wrong with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import audits as A
from quarry.operators import code as C

# Names that frameworks and tests own, what waits, and limits.
PAGE_FUNCTIONS = ("getServerSideProps", "getStaticProps", "getStaticPaths", "getInitialProps")
TEST_FUNCTIONS = ("describe", "it", "test", "expect", "beforeEach", "afterEach", "beforeAll", "afterAll", "jest", "mock", "spy")
PROMISE_TYPE = r"(?i)promise<|^promise|thenable<|awaitable<|promiselike<"
ASYNC_CALL = r"\.(then|catch|finally)$|^Promise\.(all|race|allSettled|any|resolve|reject)$|^(fetch|setTimeout|setInterval|queueMicrotask)$|^axios\b|^fs\.promises"
LEAST_SIZE, MOST_SIZE, MOST_PARAMETERS, MOST_BODY = 10, 10_000, 20, 50_000
PLACEHOLDERS = ("Anonymous Function", "ErrorFunction", "Unknown", "// Error parsing")


def named(nodes: DataFrame) -> DataFrame:
    """path, node_id, name, way, certainty: how a function came to its name: its own, a variable's, a property's, an attribute's, an
    export's, the call's that it is handed to, or none."""
    own = nodes.where("kind = 'Function'").select("path", "node_id", "parent_id", F.col("name").alias("own"), F.col("text").alias("flavour"))
    parents = nodes.select("path", F.col("node_id").alias("parent_id"), F.col("kind").alias("pk"), F.col("name").alias("pn"))
    rows = own.join(parents, ["path", "parent_id"], "left")
    arrow = F.col("flavour").contains("arrow")
    way = (
        F.when(F.col("own").isNotNull() & (F.col("pk") == "Variable"), "variable").when(F.col("own").isNotNull() & (F.col("pk") == "Property"), "property")
        .when(F.col("own").isNotNull() & ~arrow, "own").when(F.col("own").isNotNull(), "holder").when(F.col("pk") == "Export", "export").when(F.col("pk") == "Call", "call").otherwise("none")
    )
    sure = reduce(lambda c, x: c.when(F.col("way") == x[0], x[1]), (("own", 1.0), ("variable", 1.0), ("property", 0.9), ("holder", 0.8), ("export", 0.8), ("call", 0.7)), F).otherwise(0.1)
    name = F.coalesce("own", F.when(F.col("way") == "export", F.coalesce("pn", F.lit("default"))), F.when(F.col("way") == "call", F.concat("pn", F.lit(" callback"))), F.lit("anonymous"))
    return rows.withColumn("way", way).select("path", "node_id", name.alias("name"), "way", sure.alias("certainty"))


def parameters(nodes: DataFrame) -> DataFrame:
    """path, node_id (the function's), place, name, type, optional, has_default, form (plain, rest, object, array)."""
    own = nodes.where("kind = 'Parameter'").select("path", F.col("parent_id").alias("node_id"), F.col("node_id").alias("p"), "exit", "name", F.coalesce("text", F.lit("")).alias("text"))
    form = F.when(F.col("name").startswith("..."), "rest").when(F.col("name").startswith("{"), "object").when(F.col("name").startswith("["), "array").otherwise("plain")
    default = F.col("exit") > F.col("p")
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("path", "node_id").orderBy("p"))
    kind = F.regexp_replace("text", r"^\?\s*:?\s*", "")
    return own.select("path", "node_id", place.alias("place"), "name", F.when(kind == "", "unknown").otherwise(kind).alias("type"), (F.col("text").startswith("?") | default).alias("optional"), default.alias("has_default"), form.alias("form"))


def waiting(nodes: DataFrame) -> DataFrame:
    """path, node_id, name, modifier, promise_type, awaits, chains, is_async: what shows that a function waits. Code of nested functions
    counts for those alone."""
    rows = C.functions(nodes)
    awaits = nodes.where("kind = 'Await'").groupBy("path", F.col("owner").alias("node_id")).agg(F.count(F.lit(1)).alias("awaits"))
    chains = nodes.where((F.col("kind").isin("Call", "New")) & (F.col("name").rlike(ASYNC_CALL) | F.col("name").rlike(r"^new\s+Promise\b"))).groupBy("path", F.col("owner").alias("node_id")).agg(F.count(F.lit(1)).alias("chains"))
    both = rows.join(awaits, ["path", "node_id"], "left").join(chains, ["path", "node_id"], "left").fillna(0, ["awaits", "chains"])
    typed = F.col("return_type").rlike(PROMISE_TYPE)
    return both.select("path", "node_id", "name", F.col("is_async").alias("modifier"), typed.alias("promise_type"), "awaits", "chains", (F.col("is_async") | typed | (F.col("awaits") > 0) | (F.col("chains") > 0)).alias("is_async"))


def calls(nodes: DataFrame) -> DataFrame:
    """path, node_id, name, called, used: distinct names that a function calls, and that it reads, without its own parameters."""
    made = nodes.where("kind = 'Call'").groupBy("path", F.col("owner").alias("node_id")).agg(F.sort_array(F.collect_set("name")).alias("called"))
    taken = nodes.where("kind = 'Parameter'").select("path", F.col("parent_id").alias("node_id"), F.explode(F.regexp_extract_all("name", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))).alias("root"))
    read = nodes.where("kind = 'Identifier' and name not in ('null', 'undefined', 'true', 'false', 'this')").select("path", F.col("owner").alias("node_id"), F.regexp_extract("name", r"^[A-Za-z_$][\w$]*", 0).alias("root")).distinct()
    used = read.join(taken, ["path", "node_id", "root"], "left_anti").where("root <> ''").groupBy("path", "node_id").agg(F.sort_array(F.collect_set("root")).alias("used"))
    none = F.array().cast("array<string>")
    rows = C.functions(nodes).select("path", "node_id", "name").join(made, ["path", "node_id"], "left").join(used, ["path", "node_id"], "left")
    return rows.select("path", "node_id", "name", F.coalesce("called", none).alias("called"), F.coalesce("used", none).alias("used"))


def bodies(nodes: DataFrame) -> DataFrame:
    """path, node_id, name, n_nodes, n_returns, n_variables, n_calls, depth, cyclomatic, cognitive: a function's own body."""
    own = nodes.where("node_id <> owner").groupBy("path", F.col("owner").alias("node_id")).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("kind") == "Return").alias("n_returns"), F.count_if(F.col("kind") == "Variable").alias("n_variables"), F.count_if(F.col("kind") == "Call").alias("n_calls"), F.max("nesting").alias("depth"),
    )
    return C.functions(nodes).select("path", "node_id", "name").join(own, ["path", "node_id"], "left").join(C.complexity(nodes), ["path", "node_id"], "left").fillna(0)


def classified(nodes: DataFrame) -> DataFrame:
    """path, node_id, name, class: component, hook, reducer, action creator, store, provider, handler, or plain, the first that fits."""
    rows = C.functions(nodes)
    marks = nodes.where("kind = 'JsxElement'").groupBy("path", F.col("owner").alias("node_id")).agg(F.lit(True).alias("marks"), F.max(F.col("name").rlike("Provider$")).alias("provides"))
    switches = nodes.where("kind = 'Switch'").select("path", F.col("owner").alias("node_id"), F.lit(True).alias("switches")).distinct()
    makes = nodes.where((F.col("kind") == "Call") & F.col("name").rlike(r"^(create|configureStore|createStore|createSlice|atom|proxy)$")).select("path", F.col("owner").alias("node_id"), F.lit(True).alias("makes")).distinct()
    types = nodes.where("kind = 'Property' and name = 'type'").select("path", F.col("owner").alias("node_id"), F.lit(True).alias("typed")).distinct()
    for part in (marks, switches, makes, types):
        rows = rows.join(part, ["path", "node_id"], "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = F.col("name")
    kind = (
        F.when(no("provides") | n.rlike("Provider$"), "provider").when(n.rlike("^[A-Z]") & no("marks"), "component").when(n.rlike("^use[A-Z]"), "hook").when(n.rlike("(?i)reducer$") | (no("switches") & F.exists("params", lambda p: p["name"] == "action")), "reducer")
        .when(no("makes") | n.rlike("(?i)store$"), "store").when(no("typed") & n.rlike("^(set|add|remove|update|fetch|load|create|delete|toggle)[A-Z]|Action$"), "action creator").when(n.rlike("^(on|handle)[A-Z]"), "handler").otherwise("plain")
    )
    return rows.select("path", "node_id", "name", kind.alias("class"))


def left_out(name: Column, path: Column, size: Column, tests: bool = True, custom: tuple[str, ...] = ()) -> Column:
    """Why a function isn't listed: the first of a bad name, a fallback name, a test file, a dependency's file, a route handler, a page's
    data function, a test's function, a story, too small, too large, or a caller's pattern (with * and ?); null if it is listed."""
    globs = reduce(lambda c, g: c | F.lower(name).rlike("^" + g.lower().replace(".", r"\.").replace("*", ".*").replace("?", ".") + "$"), custom, F.lit(False))
    reason = (
        F.when(name.isNull() | (F.btrim(name) == ""), "no name").when(name.isin("Anonymous Function", "ErrorFunction"), "fallback name")
        .when(F.lit(tests) & path.rlike(r"\.(test|spec)\.[jt]sx?$|__tests__/|/tests?/"), "test file").when(path.contains("node_modules/"), "dependency")
        .when((name.contains("Default") | (name == "handler")) & path.contains("/pages/api/"), "route handler").when(name.isin(*PAGE_FUNCTIONS), "page function")
        .when(reduce(lambda c, w: c | F.lower(name).contains(w.lower()), TEST_FUNCTIONS[3:4] + TEST_FUNCTIONS[4:8], F.lit(False)) | F.lower(name).isin(*(w.lower() for w in TEST_FUNCTIONS)), "test function")
        .when(F.lower(name).rlike("story|stories") | ((name == "default") & path.contains(".stories.")), "story")
        .when(size < LEAST_SIZE, "too small").when(size > MOST_SIZE, "too large").when(globs, "custom")
    )
    return reason


def issues(functions: DataFrame) -> DataFrame:
    """component, name, category, severity, field of functions(component, name, params, return_type, body, dependencies, called, is_async)."""
    c = F.col
    v = lambda condition, category, severity, field: F.when(condition, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(field).alias("field")))
    needed = ("component", "name", "params", "return_type", "body", "dependencies", "called", "is_async")
    body = F.coalesce("body", F.lit(""))
    found = [v(c(f).isNull(), "required", "error", f) for f in needed]
    found += [v(F.btrim(c(f)) == "", "format", "warning", f) for f in ("component", "name")]
    found += [
        v((F.btrim("name") != "") & ~c("name").rlike(r"^[A-Za-z_$][\w$.]*$"), "format", "warning", "name"), v(c("return_type") == "unknown", "format", "warning", "return_type"), v(c("body").isNotNull() & (F.btrim(body) == ""), "format", "warning", "body"),
        v(F.length(body) > MOST_BODY, "format", "warning", "body"), v(F.size("params") > MOST_PARAMETERS, "format", "warning", "params"),
    ]
    found += [v(c("name").contains(p), "quality", "warning", "name") for p in PLACEHOLDERS] + [v(body.contains(p), "quality", "info", "body") for p in PLACEHOLDERS]
    found += [
        v((F.size("dependencies") == 0) & (F.size("called") == 0) & (F.length(body) > 100), "quality", "info", "dependencies"),
        v(~c("is_async") & body.rlike(r"\bawait\b"), "consistency", "warning", "is_async"),
        v(F.exists(F.coalesce("params", F.array().cast("array<string>")), lambda p: (F.length(p) > 2) & ~body.contains(p)) & (body != ""), "consistency", "info", "params"),
    ]
    rows = functions.select("component", "name", F.explode(F.array_compact(F.array(*found))).alias("x"))
    return rows.select("component", "name", "x.category", "x.severity", "x.field")


def quality(functions: DataFrame) -> DataFrame:
    """component, name, errors, warnings, infos, valid, score: 100 less points for issues, plus points for what was found."""
    found = issues(functions).select(F.col("component").alias("c2"), F.col("name").alias("n2"), "severity")
    n = found.groupBy("c2", "n2").agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")))
    rows = functions.join(n, F.col("component").eqNullSafe(F.col("c2")) & F.col("name").eqNullSafe(F.col("n2")), "left").select("component", "name", "return_type", "dependencies", "called", "body", *(F.coalesce(f"{s}s", F.lit(0)).alias(f"{s}s") for s in ("error", "warning", "info")))
    score = A.function_quality(F.col("errors"), F.col("warnings"), F.col("infos"), F.col("return_type"), F.size("dependencies"), F.size("called"), F.coalesce("body", F.lit("")))
    return rows.select("component", "name", "errors", "warnings", "infos", (F.col("errors") == 0).alias("valid"), score.alias("score"))


def issue_statistics(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "category").agg(F.count(F.lit(1)).alias("n"))
