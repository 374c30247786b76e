"""Error handling: what each function risks, how it handles it, and what components and the project make of it, over syntax nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.text import round_half_up
from quarry.operators import code as C

#: Indicators of risk: name, weight, pattern on the text of a call, framework only (fixed values). Patterns that name a bare function
#: end at a word boundary, as the text of a call holds no parenthesis.
RISKS = (
    ("server", 2, r"\b(cookies|headers|notFound|redirect|permanentRedirect|unstable_noStore|revalidatePath|revalidateTag)$|getServerSideProps|getStaticProps|getStaticPaths|getInitialProps", True),
    ("router", 1, r"router\.(push|replace|back|forward|reload)|\b(useRouter|useSearchParams|usePathname|useParams)$|useSelectedLayoutSegment", True),
    ("authentication", 2, r"signIn|signOut|authenticate|authorize|getSession|useSession|jwt\.(sign|verify)|bcrypt\.(hash|compare)|passport\.|auth0\.|firebase\.auth|supabase\.auth|clerk\.", False),
    ("async", 2, r"\.(then|catch|finally)$|Promise\.(all|race|allSettled|any)|setTimeout|setInterval|requestAnimationFrame|queueMicrotask|process\.nextTick", False),
    ("file", 2, r"FileReader|\b(File|Blob)$|URL\.(createObjectURL|revokeObjectURL)|FormData|\b(import|require)$|\bcache\.|indexedDB|fs\.(readFile|writeFile|readdir)|path\.(join|resolve)", False),
    ("network", 2, r"WebSocket|EventSource|RTCPeerConnection|RTCDataChannel|navigator\.serviceWorker|self\.registration|pushManager|showNotification|\bWorker$|SharedWorker|apollo|graphql|relay|\bfetch$|axios|unstable_cache", False),
    ("parsing", 1, r"JSON\.parse|yaml\.(parse|load)|xml2js|csv\.(parse|stringify)|querystring\.(parse|stringify)|qs\.(parse|stringify)|Date\.(parse|now)|\b(moment|dayjs)$|luxon|parseInt|parseFloat|\b(Number|URL)$|URLSearchParams|btoa|atob|Buffer\.(from|toString)|searchParams\.(get|getAll)", False),
    ("external_api", 2, r"(?i:stripe|paypal|square|auth0|cognito|facebook|twitter|linkedin|google|mapbox|vercel|planetscale|supabase)|gtag|analytics|mixpanel|amplitude|firebase\.auth|\b(aws|gcp|azure)\.", False),
    ("database", 2, r"(?i:mongodb|dynamodb|firestore|cosmosdb|neo4j|arangodb|elasticsearch|solr|algolia|redis|memcached|drizzle|planetscale|neon)|localStorage|sessionStorage|indexedDB|prisma\.|supabase\.", False),
    ("state", 1, r"\bset[A-Z]|dispatch|zustand|jotai|valtio|recoil|formik|react-hook-form|final-form|router\.(push|replace|go)|navigate|history\.(push|replace)|revalidatePath|revalidateTag", False),
    ("calculation", 1, r"Math\.(pow|sqrt|log|exp|sin|cos|tan)|mathjs|lodash\.(sum|mean|max|min|sortBy|groupBy)|ramda\.|d3\.(scale|interpolate|format)|crypto\.(createHash|createHmac|randomBytes)|bcrypt|scrypt|zlib\.(compress|decompress)|pako\.", False),
    ("third_party", 1, r"axios|lodash|moment|dayjs|uuid|classnames|formik|\byup\b|\bzod\b|\bjoi\b|lottie|\bthree\b|\bd3\b|plotly|leaflet|mapbox|prisma", False),
    ("transform", 1, r"\.(map|filter|reduce|find|sort|slice|splice)$|Object\.(keys|values|entries|assign|freeze|seal)|\b(String|Number|Boolean)$|Array\.(from|of)|validate|schema\.|\.(check|assert)|serialize|stringify|encode|decode|searchParams\.(toString|sort)", False),
)
#: Libraries of error boundaries by the package that a tag is imported from (fixed values).
BOUNDARIES = {"react-error-boundary": "react-error-boundary", "@sentry/react": "Sentry", "@sentry/nextjs": "Sentry Next.js", "@tanstack/react-query": "React Query", "@remix-run/react": "Remix", "next": "Next.js"}
#: Elements that stand for something that went wrong or isn't there yet: kind, pattern on the tag, pattern on attribute names and values.
FALLBACKS = (
    ("error", r"(?i)^(error|fallback|errorstate|errorpage|errorview|errormessage|errorcomponent|alert|notification|banner|toast|snackbar|status|state|condition|callout|admonition|notice)$", r"error"),
    ("loading", r"(?i)^(loading|loader|spinner|skeleton|placeholder|shimmer|circularprogress|linearprogress|pulse|wave|bars|dots|activityindicator|refreshindicator)$", r"loading|pending|fetching|isFetching"),
    ("empty", r"(?i)^(empty|emptystate|nodata|notfound|placeholder|zerostate|nullstate|voidstate|blankstate|missingstate)$", r"empty|noData|notFound"),
    ("retry", r"(?i)^(retry|retrybutton|tryagain|reload|refresh)$", r"retry|onRetry|refetch"),
    ("suspense", r"^(React\.)?Suspense$", r"^$"),
    ("skeleton", r"(?i)skeleton|shimmer|placeholder", r"^$"),
)
LOGGING = r"console\.(error|warn|log)|logger\.(error|warn|info)|log\.(error|warn|info)|captureException|captureMessage|reportError|trackError|bugsnag\.(notify|leaveBreadcrumb)|rollbar\.(error|warning|info)|LogRocket\.(captureException|log)|amplitude\.(logEvent|track)|mixpanel\.track|analytics\.track"
BROWSER = r"navigator\.(geolocation\.(getCurrentPosition|watchPosition)|mediaDevices\.(getUserMedia|getDisplayMedia)|permissions\.query|serviceWorker\.register|clipboard\.(read|write))|\bfetch$|XMLHttpRequest|WebSocket|(localStorage|sessionStorage)\.(getItem|setItem)|indexedDB\.open|caches\.(open|match)|document\.execCommand|FileReader"
FORMS = r"(?i)setError|formState|validat|\.safeParse|\.parseAsync|register$|handleSubmit"
STATES = (
    ("useState", r"^(React\.)?useState$"), ("useReducer", r"^(React\.)?useReducer$"), ("context", r"^(React\.)?useContext$"), ("redux", r"^(useSelector|useDispatch|useStore)$"), ("zustand", r"^use\w*Store$"),
    ("jotai", r"^(useAtom|useAtomValue|useSetAtom)$"), ("query", r"^use(Query|Mutation|InfiniteQuery)$"), ("swr", r"^useSWR\w*$"),
)
_ERROR_NAME = r"(?i)err|fail|exception|invalid"


def _owned(nodes: DataFrame, condition: str | Column, name: str) -> DataFrame:
    return nodes.where(condition).select("path", F.col("owner").alias("node_id")).distinct().withColumn(name, F.lit(True))


def risks(nodes: DataFrame, framework: bool = True) -> DataFrame:
    """path, node_id, name, line, indicators, risk, should_handle, handled and why: a row for each function.

    A function should handle errors from 3 points on; from 2 where it works on a server, from 1 in a route handler of the framework."""
    calls = nodes.where("kind in ('Call', 'New')").select("path", F.col("owner").alias("node_id"), F.regexp_replace("name", r"\?\.", ".").alias("call"))
    hits = F.array_compact(F.array(*(F.when(F.col("call").rlike(p), F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"))) for n, w, p, own in RISKS if framework or not own)))
    found = calls.select("path", "node_id", F.explode(hits).alias("x"))
    waits = nodes.where("kind = 'Await'").select("path", F.col("owner").alias("node_id"), F.struct(F.lit("async").alias("name"), F.lit(2).alias("weight")).alias("x"))
    per = found.union(waits).groupBy("path", "node_id").agg(F.sort_array(F.collect_set("x")).alias("found"))
    rows = C.functions(nodes).join(per, ["path", "node_id"], "left")
    for part in (propagation(nodes), _owned(nodes, "kind = 'Try'", "tries"), _owned(nodes, F.col("kind").isin("Call", "New") & F.col("name").rlike(LOGGING), "logs")):
        rows = rows.join(part, ["path", "node_id"], "left")
    none = F.array().cast("array<struct<name:string,weight:int>>")
    listed = F.coalesce("found", none)
    total = F.aggregate(listed, F.lit(0), lambda s, x: s + x.weight) + F.when(F.col("is_async") & ~F.exists(listed, lambda x: x["name"] == "async"), 2).otherwise(0)
    names = F.array_sort(F.array_distinct(F.concat(F.transform(listed, lambda x: x["name"]), F.when(F.col("is_async"), F.array(F.lit("async"))).otherwise(F.array().cast("array<string>")))))
    out = rows.withColumns({"risk": total, "indicators": names})
    api = F.col("path").rlike("(^|/)api/") & F.lit(framework)
    limit = F.when(api, 1).when(F.array_contains("indicators", "server"), 2).otherwise(3)
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    handled = no("tries") | no("throws") | no("rethrows") | no("async_handling") | (F.size(F.coalesce("error_types", F.array().cast("array<string>"))) > 0)
    return out.select(
        "path", "node_id", "name", "line", "indicators", "risk", (F.col("risk") >= limit).alias("should_handle"), handled.alias("handled"), no("throws").alias("throws"), no("rethrows").alias("rethrows"),
        no("async_handling").alias("async_handling"), F.coalesce("error_types", F.array().cast("array<string>")).alias("error_types"),
    )


def propagation(nodes: DataFrame) -> DataFrame:
    """path, node_id, throws, rethrows, async_handling, error_types: what a function throws, throws again, and waits for inside of try."""
    throws = nodes.where("kind = 'Throw'").select("path", "node_id", "exit", "owner")
    catches = nodes.where("kind = 'Catch'").select(F.col("path").alias("p"), F.col("node_id").alias("c"), F.col("exit").alias("c_exit"))
    again = throws.join(catches, (F.col("path") == F.col("p")) & (F.col("node_id") > F.col("c")) & (F.col("node_id") <= F.col("c_exit")), "left_semi").select("path", F.col("owner").alias("node_id"), F.lit(True).alias("rethrows")).distinct()
    made = nodes.where("kind = 'New'").select("path", "parent_id", F.regexp_extract("name", r"new\s+([\w.$]+)", 1).alias("type"))
    types = throws.join(made, (throws["path"] == made["path"]) & (throws["node_id"] == made["parent_id"])).select(throws["path"], F.col("owner").alias("node_id"), "type")
    caught = nodes.where("kind = 'Identifier' and name rlike '^(e|err|error|ex|exception)\\\\.'").select("path", "node_id", "owner")
    used = caught.join(catches, (F.col("path") == F.col("p")) & (F.col("node_id") > F.col("c")) & (F.col("node_id") <= F.col("c_exit")), "left_semi").select("path", F.col("owner").alias("node_id"), F.lit("Error").alias("type"))
    named = types.union(used).where("type <> ''").groupBy("path", "node_id").agg(F.sort_array(F.collect_set("type")).alias("error_types"))
    tries = nodes.where("kind = 'Try'").select(F.col("path").alias("p"), F.col("node_id").alias("t"), F.col("exit").alias("t_exit"))
    waits = nodes.where("kind = 'Await'").select("path", "node_id", "owner").join(tries, (F.col("path") == F.col("p")) & (F.col("node_id") > F.col("t")) & (F.col("node_id") <= F.col("t_exit")), "left_semi")
    rejected = nodes.where("kind = 'Call' and name rlike 'Promise\\\\.reject|\\\\.catch$|^catch$'").select("path", "node_id", "owner")
    handling = waits.union(rejected).select("path", F.col("owner").alias("node_id"), F.lit(True).alias("async_handling")).distinct()
    rows = throws.select("path", F.col("owner").alias("node_id"), F.lit(True).alias("throws")).distinct()
    for part in (again, named, handling):
        rows = rows.join(part, ["path", "node_id"], "full")
    return rows


def try_blocks(nodes: DataFrame) -> DataFrame:
    """path, node_id, line, scope, logs, renders, updates, nested: try statements with a catch.

    The scope is the nearest of what is around: markup renders; effect hooks, other hooks and life-cycle methods are effects;
    handlers are events; a component's own body renders; else other."""
    blocks = nodes.where("kind = 'Try'").select("path", "node_id", "exit", "line", "owner")
    catches = nodes.where("kind = 'Catch'").select("path", F.col("parent_id").alias("node_id"), F.col("node_id").alias("c"), F.col("exit").alias("c_exit"))
    rows = blocks.join(catches, ["path", "node_id"])
    around = nodes.where("kind in ('JsxElement', 'JsxExpression', 'Call', 'JsxAttribute', 'Function', 'Property')").select(F.col("path").alias("p"), F.col("node_id").alias("a"), F.col("exit").alias("a_exit"), F.col("kind").alias("k"), F.col("name").alias("n"))
    n, k = F.col("n"), F.col("k")
    scope = (
        F.when(k == "JsxAttribute", F.when(n.rlike("^on[A-Z]"), "event"))
        .when(k.isin("JsxElement", "JsxExpression"), "render")
        .when(k == "Call", F.when(n.rlike("^use(Layout|Insertion)?Effect$"), "effect").when(n.isin("useCallback", "useMemo"), "other").when(n.rlike("^use[A-Z]"), "effect").when(n.rlike(r"(add|remove)EventListener$|\.(on|off)$"), "event"))
        .when(k == "Property", F.when(n.rlike("^(on|handle)[A-Z]"), "event"))
        .otherwise(F.when(n.rlike("^(on|handle)[A-Z]"), "event").when(n == "render", "render").when(n.rlike("^component(DidMount|DidUpdate|WillUnmount)$"), "effect").when(n.rlike("^[A-Z]"), "render"))
    )
    # An attribute's own expression is no rendering of markup.
    held = around.withColumn("scope", scope).where("scope is not null").select("p", "a", "a_exit", "scope")
    attributes = around.where("k = 'JsxAttribute'").select(F.col("p").alias("p2"), F.col("a").alias("parent"))
    inner = nodes.where("kind = 'JsxExpression'").select(F.col("path").alias("p2"), F.col("node_id").alias("a2"), F.col("parent_id").alias("parent")).join(attributes, ["p2", "parent"]).select(F.col("p2").alias("p"), F.col("a2").alias("a"))
    held = held.join(inner, ["p", "a"], "left_anti")
    met = rows.join(held, (F.col("path") == F.col("p")) & (F.col("node_id") > F.col("a")) & (F.col("node_id") <= F.col("a_exit")), "left")
    nearest = met.groupBy("path", "node_id", "line", "owner", "c", "c_exit").agg(F.max_by("scope", "a").alias("scope"))
    inside = nodes.select(F.col("path").alias("q"), F.col("node_id").alias("i"), F.col("kind").alias("ik"), F.col("name").alias("iname"))
    body = nearest.join(inside, (F.col("path") == F.col("q")) & (F.col("i") > F.col("c")) & (F.col("i") <= F.col("c_exit")), "left")
    per = body.groupBy("path", "node_id", "line", "scope").agg(
        F.coalesce(F.max((F.col("ik") == "Call") & F.col("iname").rlike(LOGGING)), F.lit(False)).alias("logs"), F.coalesce(F.max(F.col("ik") == "JsxElement"), F.lit(False)).alias("renders"),
        F.sort_array(F.collect_set(F.when((F.col("ik") == "Call") & F.col("iname").rlike("^set[A-Z]"), F.col("iname")))).alias("updates"),
    )
    outer = blocks.select(F.col("path").alias("p3"), F.col("node_id").alias("o"), F.col("exit").alias("o_exit"))
    depth = blocks.join(outer, (F.col("path") == F.col("p3")) & (F.col("node_id") > F.col("o")) & (F.col("node_id") <= F.col("o_exit")), "left").groupBy("path", "node_id").agg(F.count("o").alias("nested"))
    return per.join(depth, ["path", "node_id"]).withColumn("scope", F.coalesce("scope", F.lit("other")))


def boundaries(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """path, line, library, features: classes that catch errors, and tags from a library of boundaries; names(path, local, specifier)."""
    classes = nodes.where("kind = 'Class'").select("path", F.col("node_id").alias("c"), F.col("exit").alias("c_exit"), "line")
    methods = nodes.where("kind = 'Function'").select("path", F.col("parent_id").alias("c"), F.col("node_id").alias("m"), F.col("exit").alias("m_exit"), F.col("name").alias("method"))
    both = classes.join(methods, ["path", "c"])
    catching = both.groupBy("path", "c").agg(F.max(F.col("method").isin("componentDidCatch", "getDerivedStateFromError")).alias("catches")).where("catches").select("path", "c")
    own = both.join(catching, ["path", "c"])
    inside = nodes.select(F.col("path").alias("q"), F.col("node_id").alias("i"), F.col("kind").alias("ik"), F.col("name").alias("iname"))
    seen = own.join(inside, (F.col("path") == F.col("q")) & (F.col("i") > F.col("m")) & (F.col("i") <= F.col("m_exit")), "left")
    m, k, n = F.col("method"), F.col("ik"), F.coalesce("iname", F.lit(""))
    marks = F.array_compact(F.array(
        F.when(m == "componentDidCatch", "error-logging"), F.when((m == "componentDidCatch") & (k == "Call") & n.rlike("Sentry|captureException"), "external-logging"),
        F.when((m == "componentDidCatch") & (k == "Call") & n.contains("console.error"), "console-logging"), F.when(m == "getDerivedStateFromError", "state-update"),
        F.when((m == "render") & (k == "JsxElement"), "fallback-ui"), F.when((m == "render") & (k == "Conditional"), "conditional-render"),
    ))
    custom = seen.groupBy("path", "c", "line").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(marks)))).alias("features")).select("path", "line", F.lit("custom-class").alias("library"), "features")
    tags = nodes.where("kind = 'JsxElement'").select("path", F.substring_index("name", ".", 1).alias("local"), F.col("name").alias("tag"), "line")
    library = reduce(lambda c, s: c.when(F.col("specifier") == s, BOUNDARIES[s]), BOUNDARIES, F)
    bounded = tags.join(names.select("path", "local", "specifier"), ["path", "local"]).withColumn("library", library.otherwise(None))
    bounded = bounded.where(F.col("library").isNotNull() & F.col("tag").rlike("Boundary|Reset"))
    file = nodes.where("kind = 'Program'").where(P.stem(F.col("path")).isin("error", "global-error") & F.col("path").rlike("(^|/)app/")).select("path", "line", F.lit("Next.js").alias("library"), F.array(F.lit("app-router")).alias("features"))
    return custom.union(bounded.select("path", "line", "library", F.array().cast("array<string>"))).union(file)


def patterns(nodes: DataFrame) -> DataFrame:
    """path, line, pattern: calls that log, set error states, use risky browser interfaces, check forms or wait, and choices on errors."""
    n = F.col("name")
    calls = nodes.where("kind in ('Call', 'New')")
    kind = F.array_compact(F.array(
        F.when(n.rlike(LOGGING), "error-logging"), F.when(n.rlike(r"^set\w*(Error|Failed|Invalid)") | n.rlike(r"^(dispatch|setError)$"), "state-update"), F.when(n.rlike(BROWSER), "browser-api"),
        F.when(n.rlike(FORMS), "form-validation"), F.when(n.rlike(r"\.catch$|Promise\.(reject|allSettled)|^catch$"), "async-handling"),
    ))
    found = calls.select("path", "line", F.explode(kind).alias("pattern"))
    choices = nodes.where("kind in ('Conditional', 'Logical', 'If')").select("path", "parent_id", "node_id", "line", "kind")
    read = nodes.where((F.col("kind") == "Identifier") & n.rlike(_ERROR_NAME)).select("path", "parent_id", F.col("node_id").alias("r"))
    # What a choice tests stands beside it (&&, ?:) or first inside of it (if).
    beside = choices.where("kind <> 'If'").join(read, ["path", "parent_id"]).where("r < node_id").select("path", "line", F.lit("conditional-render").alias("pattern")).distinct()
    return found.union(beside)


def error_states(nodes: DataFrame) -> DataFrame:
    """path, line, kind, variable: state that is named after errors, or that a query library hands out."""
    calls = nodes.where("kind = 'Call'").select("path", "parent_id", "name", "line")
    kind = reduce(lambda c, s: c.when(F.col("name").rlike(s[1]), s[0]), STATES, F)
    held = nodes.where("kind = 'Variable'").select("path", F.col("node_id").alias("parent_id"), F.col("name").alias("variable"))
    rows = calls.withColumn("kind", kind.otherwise(None)).where("kind is not null").join(held, ["path", "parent_id"])
    return rows.where(F.col("variable").rlike(_ERROR_NAME)).select("path", "line", "kind", "variable")


def fallback_elements(found: DataFrame) -> DataFrame:
    """path, node_id, line, tag, kind, over elements(path, node_id, tag, props, line): the first kind that a tag or its attributes name."""
    names = F.map_keys("props")
    values = F.array_join(F.map_values("props"), " ")
    kind = F
    for name, tag, attribute in FALLBACKS:
        by_attribute = F.array_join(names, " ").rlike(attribute) if attribute != "^$" else F.lit(False)
        by_value = values.rlike(rf"['\"]({attribute})['\"]") if attribute != "^$" else F.lit(False)
        kind = kind.when(F.col("tag").rlike(tag) | by_attribute | by_value, name)
    return found.withColumn("kind", kind.otherwise(None)).where("kind is not null").select("path", "node_id", "line", "tag", "kind")


def significant(facts: DataFrame) -> DataFrame:
    """facts, and significant: boundaries or try blocks, two kinds of handling, or states beside fallbacks or patterns; pages and layouts
    of the framework with states or functions that count. facts(path, boundaries, tries, states, fallbacks, patterns, functions)."""
    kinds = ["boundaries", "tries", "states", "fallbacks", "patterns", "functions"]
    has = {k: F.col(k) > 0 for k in kinds}
    several = sum((h.cast("int") for h in has.values()), F.lit(0)) >= 2
    key = P.stem(F.col("path")).isin("layout", "page", "error", "_app", "_document", "_error") & (has["states"] | has["functions"])
    return facts.withColumn("significant", key | several | has["boundaries"] | has["tries"] | (has["states"] & (has["fallbacks"] | has["patterns"])))


def kept_function(handled: Column, should: Column, risk: Column, n_indicators: Column, path: Column) -> Column:
    """Whether a function is listed with its component."""
    return handled | (should & (risk >= 4)) | (n_indicators >= F.when(path.rlike("/(api|app)/"), 2).otherwise(3))


def component_rollup(components: DataFrame, functions: DataFrame, tries: DataFrame, caught: DataFrame, states: DataFrame, fallbacks: DataFrame, seen: DataFrame) -> DataFrame:
    """path, counts by kind, significant: a row for each file with components, each finding counted once a line."""
    files = components.select("path").distinct()
    kept = functions.where(kept_function(F.col("handled"), F.col("should_handle"), F.col("risk"), F.size("indicators"), F.col("path")))
    telling = seen.where(F.col("pattern").isin("error-logging", "state-update", "async-handling"))
    parts = {"boundaries": caught, "tries": tries, "states": states, "fallbacks": fallbacks, "patterns": telling, "functions": kept}
    rows = files
    for name, df in parts.items():
        keys = ["path", "line"] + [c for c in ("kind", "pattern", "library", "name") if c in df.columns]
        rows = rows.join(df.dropDuplicates(keys).groupBy("path").agg(F.count(F.lit(1)).alias(name)), "path", "left")
    return significant(rows.fillna(0, list(parts)))


def summary(rollup: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: components, those with handling, coverage in percent, boundaries, try blocks, functions that handle, that should, that
    miss it, and the risk of those that should: high from 5, medium from 3, else low."""
    c = rollup.agg(
        F.count(F.lit(1)).alias("components"), F.count_if("significant").alias("with_handling"), round_half_up(100 * F.try_divide(F.count_if("significant"), F.count(F.lit(1))), 2).alias("coverage"),
        F.coalesce(F.sum(F.when(F.col("significant"), F.col("boundaries"))), F.lit(0)).alias("boundaries"), F.coalesce(F.sum(F.when(F.col("significant"), F.col("tries"))), F.lit(0)).alias("tries"),
    )
    should, risk = F.col("should_handle"), F.col("risk")
    f = functions.agg(
        F.count_if("handled").alias("functions_handled"), F.count_if(should).alias("functions_needing"), F.count_if(should & ~F.col("handled")).alias("functions_missing"),
        F.count_if(should & (risk >= 5)).alias("high"), F.count_if(should & (risk >= 3) & (risk < 5)).alias("medium"), F.count_if(should & (risk < 3)).alias("low"),
    )
    return c.join(F.broadcast(f))  # one row each


def library_usage(caught: DataFrame) -> DataFrame:
    return caught.groupBy("library").agg(F.count(F.lit(1)).alias("n"))


def gaps(functions: DataFrame) -> DataFrame:
    """path, name, line, risk: functions that should handle errors and don't, the riskiest first."""
    return functions.where("should_handle and not handled").select("path", "name", "line", "risk", F.row_number().over(W.partitionBy("path").orderBy(F.desc("risk"), "line", "name")).alias("place"))
