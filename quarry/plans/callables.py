"""Functions over a small project's syntax nodes and over literal facts, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import callables as K
from quarry.plans.common import named, node_table
from quarry.registry import query
from quarry.sources import syntax

SOURCES = [
    ("src/a.ts", "export async function load(id: string, opts?: Options, ...rest: number[]): Promise<string> {\n  const r = await fetch(id);\n  if (r.ok) { return JSON.parse(r); }\n  return rest.map((x) => x);\n}\nexport default () => go(1);\nconst add = (a, b = 2) => a + b;\nconst o = { onSave: () => save(), make() { return 1; } };\nlist.forEach(function ({ k }) { use(k); });\nfunction later(): Promise<void> { return step().then(done); }\n"),
    ("src/b.tsx", "export const CartProvider = ({ children }) => <Ctx.Provider value={1}>{children}</Ctx.Provider>;\nexport function Card() { return <p />; }\nexport function useCart() { return 1; }\nfunction cart(state, action) { switch (action.type) { case 'a': return state; } }\nexport const addItem = (x) => ({ type: 'add', x });\nconst handleClick = () => {};\nconst makeStore = () => configureStore({});\n"),
]


def _nodes(spark: SparkSession) -> DataFrame:
    return syntax.nodes(spark.createDataFrame(SOURCES, "path string, content string"))


_N = node_table(SOURCES)
_F = "f AS (SELECT path, node_id, exit, parent_id, name, text, coalesce(name, 'anonymous') AS shown FROM n WHERE kind = 'Function')"


@query(
    "function_names",
    f"""WITH {_N}, {_F}, x AS (SELECT f.*, p.kind AS pk, p.name AS pn FROM f LEFT JOIN n p ON p.path = f.path AND p.node_id = f.parent_id), w AS (SELECT *, CASE WHEN name IS NOT NULL AND pk = 'Variable' THEN 'variable' WHEN name IS NOT NULL AND pk = 'Property' THEN 'property' WHEN name IS NOT NULL AND NOT contains(text, 'arrow') THEN 'own' WHEN name IS NOT NULL THEN 'holder' WHEN pk = 'Export' THEN 'export' WHEN pk = 'Call' THEN 'call' ELSE 'none' END AS way FROM x)
    SELECT path, coalesce(name, CASE way WHEN 'export' THEN coalesce(pn, 'default') WHEN 'call' THEN pn || ' callback' END, 'anonymous') AS name, way, CASE way WHEN 'own' THEN 1.0 WHEN 'variable' THEN 1.0 WHEN 'property' THEN 0.9 WHEN 'holder' THEN 0.8 WHEN 'export' THEN 0.8 WHEN 'call' THEN 0.7 ELSE 0.1 END::DOUBLE AS certainty FROM w""",
)
def function_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.named(_nodes(spark)).drop("node_id")


_KIND = "regexp_replace(coalesce(text, ''), '^\\?\\s*:?\\s*', '')"


@query(
    "function_parameters",
    f"""WITH {_N} SELECT path, row_number() OVER (PARTITION BY path, parent_id ORDER BY node_id)::INT AS place, name, CASE WHEN {_KIND} = '' THEN 'unknown' ELSE {_KIND} END AS type, starts_with(coalesce(text, ''), '?') OR exit > node_id AS optional, exit > node_id AS has_default,
    CASE WHEN starts_with(name, '...') THEN 'rest' WHEN starts_with(name, '{{') THEN 'object' WHEN starts_with(name, '[') THEN 'array' ELSE 'plain' END AS form FROM n WHERE kind = 'Parameter'""",
)
def function_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.parameters(_nodes(spark)).drop("node_id")


@query(
    "async_functions",
    f"""WITH {_N}, {_F}, r AS (SELECT f.path, f.node_id, f.shown AS name, contains(f.text, 'async') AS modifier, coalesce((SELECT max(regexp_matches(t.name, '{K.PROMISE_TYPE}')) FROM n t WHERE t.path = f.path AND t.parent_id = f.node_id AND t.kind = 'ReturnType'), false) AS promise_type,
    (SELECT count(*) FROM n a WHERE a.path = f.path AND a.owner = f.node_id AND a.kind = 'Await') AS awaits, (SELECT count(*) FROM n a WHERE a.path = f.path AND a.owner = f.node_id AND a.kind IN ('Call', 'New') AND (regexp_matches(a.name, '{K.ASYNC_CALL}') OR regexp_matches(a.name, '^new\\s+Promise\\b'))) AS chains FROM f)
    SELECT path, name, modifier, promise_type, awaits, chains, modifier OR promise_type OR awaits > 0 OR chains > 0 AS is_async FROM r""",
)
def async_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.waiting(_nodes(spark)).drop("node_id")


@query(
    "called_functions",
    f"""WITH {_N}, {_F}, p AS (SELECT path, parent_id AS node_id, unnest(regexp_extract_all(name, '[A-Za-z_$][\\w$]*')) AS root FROM n WHERE kind = 'Parameter'), i AS (SELECT DISTINCT path, owner AS node_id, regexp_extract(name, '^[A-Za-z_$][\\w$]*') AS root FROM n WHERE kind = 'Identifier' AND name NOT IN ('null', 'undefined', 'true', 'false', 'this'))
    SELECT f.path, f.shown AS name, coalesce((SELECT string_agg(DISTINCT c.name, ',' ORDER BY c.name) FROM n c WHERE c.path = f.path AND c.owner = f.node_id AND c.kind = 'Call'), '') AS called, coalesce((SELECT string_agg(DISTINCT i.root, ',' ORDER BY i.root) FROM i WHERE i.path = f.path AND i.node_id = f.node_id AND i.root <> '' AND NOT EXISTS (SELECT 1 FROM p WHERE p.path = i.path AND p.node_id = i.node_id AND p.root = i.root)), '') AS used FROM f""",
)
def called_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.calls(_nodes(spark)).select("path", "name", F.array_join("called", ",").alias("called"), F.array_join("used", ",").alias("used"))


@query(
    "function_bodies",
    f"""WITH {_N}, {_F} SELECT f.path, f.shown AS name, count(b.node_id) AS n_nodes, coalesce(count_if(b.kind = 'Return'), 0) AS n_returns, coalesce(count_if(b.kind = 'Variable'), 0) AS n_variables, coalesce(count_if(b.kind = 'Call'), 0) AS n_calls, coalesce(max(b.nesting), 0) AS depth FROM f LEFT JOIN n b ON b.path = f.path AND b.owner = f.node_id AND b.node_id <> b.owner GROUP BY f.path, f.node_id, f.shown""",
)
def function_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.bodies(_nodes(spark)).drop("node_id", "cyclomatic", "cognitive")


#: What reading gives.
CLASSES = [("src/a.ts", "load", "plain"), ("src/a.ts", "anonymous", "plain"), ("src/a.ts", "anonymous", "plain"), ("src/a.ts", "add", "plain"), ("src/a.ts", "onSave", "handler"), ("src/a.ts", "make", "plain"), ("src/a.ts", "anonymous", "plain"), ("src/a.ts", "later", "plain"), ("src/b.tsx", "CartProvider", "provider"), ("src/b.tsx", "Card", "component"), ("src/b.tsx", "useCart", "hook"), ("src/b.tsx", "cart", "reducer"), ("src/b.tsx", "addItem", "action creator"), ("src/b.tsx", "handleClick", "handler"), ("src/b.tsx", "makeStore", "store")]


@query("function_classes", f"WITH {named('c', CLASSES, 'path, name, class')} SELECT * FROM c")
def function_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.classified(_nodes(spark)).drop("node_id")


LISTED = [("load", "src/a.ts", 200), ("", "src/a.ts", 200), ("Anonymous Function", "src/a.ts", 200), ("load", "src/a.test.ts", 200), ("load", "node_modules/x/a.js", 200), ("handler", "src/pages/api/a.ts", 200), ("getStaticProps", "src/pages/a.tsx", 200), ("describe", "src/a.ts", 200), ("CardStory", "src/a.tsx", 200), ("f", "src/a.ts", 5), ("g", "src/a.ts", 20000), ("tmpFile", "src/a.ts", 90), ("useIt", "src/a.ts", 90), ("default", "src/a.stories.tsx", 90)]


@query(
    "function_filters",
    f"""WITH {named("f", LISTED, "name, path, size")} SELECT name, path, size, CASE WHEN trim(name) = '' THEN 'no name' WHEN name IN ('Anonymous Function', 'ErrorFunction') THEN 'fallback name' WHEN regexp_matches(path, '\\.(test|spec)\\.[jt]sx?$|__tests__/|/tests?/') THEN 'test file' WHEN contains(path, 'node_modules/') THEN 'dependency'
    WHEN (contains(name, 'Default') OR name = 'handler') AND contains(path, '/pages/api/') THEN 'route handler' WHEN name IN ('getServerSideProps', 'getStaticProps', 'getStaticPaths', 'getInitialProps') THEN 'page function' WHEN lower(name) IN ('describe', 'it', 'test', 'expect', 'jest', 'mock', 'spy') OR regexp_matches(lower(name), 'expect|beforeeach|aftereach|beforeall|afterall') THEN 'test function'
    WHEN regexp_matches(lower(name), 'story|stories') OR (name = 'default' AND contains(path, '.stories.')) THEN 'story' WHEN size < 10 THEN 'too small' WHEN size > 10000 THEN 'too large' WHEN starts_with(name, 'tmp') THEN 'custom' END AS reason FROM f""",
)
def function_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.createDataFrame(LISTED, "name string, path string, size int")
    return f.select("name", "path", "size", K.left_out(F.col("name"), F.col("path"), F.col("size"), custom=("tmp*",)).alias("reason"))


FACTS = [
    ("A", "load", "id", "Promise<string>", "await fetch(id); return 1", "fetch", "fetch", True), ("A", "wait", "x", "unknown", "await go(x)", "go", "go", False), ("B", "1bad", "", "void", "", "", "", False), ("B", "Unknown fn", "value", "number", "// Error parsing" + "x" * 100, "", "", False),
    ("C", None, "", "void", "x", "", "", False), ("C", "ok", "alpha beta", "void", "return alpha", "b", "c", False),
]
_FACT = "component, name, params, return_type, body, dependencies, called, is_async"
_LIST = "list_filter(string_split({0}, ' '), lambda x: x <> '')"


def _facts(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(FACTS, "component string, name string, params string, return_type string, body string, dependencies string, called string, is_async boolean")
    split = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    return rows.withColumns({c: split(c) for c in ("params", "dependencies", "called")})


def _issues() -> str:
    rules = [("name IS NULL", "required", "error", "name"), ("trim(name) = ''", "format", "warning", "name"), ("trim(name) <> '' AND NOT regexp_matches(name, '^[A-Za-z_$][\\w$.]*$')", "format", "warning", "name"), ("return_type = 'unknown'", "format", "warning", "return_type"), ("trim(body) = ''", "format", "warning", "body")]
    rules += [(f"contains(name, '{p}')", "quality", "warning", "name") for p in K.PLACEHOLDERS] + [(f"contains(body, '{p}')", "quality", "info", "body") for p in K.PLACEHOLDERS]
    rules += [("dependencies = '' AND called = '' AND length(body) > 100", "quality", "info", "dependencies"), ("NOT is_async AND regexp_matches(body, '\\bawait\\b')", "consistency", "warning", "is_async"), (f"len(list_filter({_LIST.format('params')}, lambda p: length(p) > 2 AND NOT contains(body, p))) > 0 AND body <> ''", "consistency", "info", "params")]
    return " UNION ALL ".join(f"SELECT component, name, '{c}' AS category, '{s}' AS severity, '{f}' AS field FROM f WHERE {w}" for w, c, s, f in rules)


_I = f"{named('f', FACTS, _FACT)}, i AS ({_issues()})"


@query("function_issues", f"WITH {_I} SELECT * FROM i")
def function_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.issues(_facts(spark))


@query("function_issue_statistics", f"WITH {_I} SELECT severity, category, count(*) AS n FROM i GROUP BY 1, 2")
def function_issue_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.issue_statistics(K.issues(_facts(spark)))


@query(
    "function_scores",
    f"""WITH {_I}, c AS (SELECT f.*, (SELECT count(*) FROM i WHERE i.component = f.component AND i.name IS NOT DISTINCT FROM f.name AND severity = 'error') AS errors, (SELECT count(*) FROM i WHERE i.component = f.component AND i.name IS NOT DISTINCT FROM f.name AND severity = 'warning') AS warnings, (SELECT count(*) FROM i WHERE i.component = f.component AND i.name IS NOT DISTINCT FROM f.name AND severity = 'info') AS infos FROM f)
    SELECT component, name, errors, warnings, infos, errors = 0 AS valid, greatest(0, least(100, 100 - 20 * errors - 10 * warnings - 2 * infos + CASE WHEN return_type NOT IN ('', 'unknown') THEN 5 ELSE 0 END + CASE WHEN dependencies <> '' THEN 3 ELSE 0 END + CASE WHEN called <> '' THEN 3 ELSE 0 END + CASE WHEN trim(body) <> '' THEN 5 ELSE 0 END)) AS score FROM c""",
)
def function_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From facts to issues to scores."""
    return K.quality(_facts(spark))
