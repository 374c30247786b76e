"""Error handling over a small project's syntax nodes and over literal facts, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import code as C
from quarry.operators import errors as E
from quarry.operators import modules as M
from quarry.plans.common import named, node_table
from quarry.registry import query
from quarry.sources import syntax

PROJECT = [
    ("src/app/api/users/route.ts", "export async function GET(req) {\n  const r = await fetch('/x');\n  return JSON.parse(await r.text());\n}\nexport function POST() { return 1; }\n"),
    ("src/lib/load.ts", "import * as Sentry from '@sentry/react';\nexport const load = async (id) => {\n  try {\n    const r = await axios.get(id);\n    return r.data.map((x) => x);\n  } catch (e) {\n    console.error(e.message);\n    throw new LoadError(e.code);\n  }\n};\nfunction check(x) { if (!x) throw new Error('x'); return Promise.reject(x); }\nfunction plain(x) { return x + 1; }\n"),
    ("src/ui/Panel.tsx", "import { ErrorBoundary } from 'react-error-boundary';\nexport function Panel() {\n  const [error, setError] = useState(null);\n  const [name, setName] = useState('');\n  const { data, isError } = useQuery(key);\n  useEffect(() => {\n    try { localStorage.getItem('a'); } catch (e) { setError(e); console.warn(e); }\n  }, []);\n  const onSave = () => { try { save(); try { again(); } catch (x) { } } catch (err) { setError(err); } };\n  if (error) return <ErrorMessage text={error} />;\n  return <ErrorBoundary fallback={<Spinner />}>{isError && <Alert variant=\"error\" />}<button onClick={() => { try { go(); } catch (e) { log.error(e); } }}>go</button><List emptyText=\"noData\" /></ErrorBoundary>;\n}\n"),
    ("src/ui/Guard.tsx", "class Guard extends React.Component {\n  static getDerivedStateFromError(e) { return { failed: true }; }\n  componentDidCatch(e, info) { Sentry.captureException(e); console.error(info); }\n  render() { return this.state.failed ? <p>failed</p> : this.props.children; }\n}\nclass Plain extends React.Component { render() { return <p />; } }\n"),
    ("src/app/error.tsx", "export default function Error({ reset }) { return <button onClick={reset}>again</button>; }\n"),
]


def _nodes(spark: SparkSession) -> DataFrame:
    return syntax.nodes(spark.createDataFrame(PROJECT, "path string, content string"))


_N = node_table(PROJECT)


def _q(p: str) -> str:
    return p.replace("'", "''")


_HITS = " UNION ALL ".join(f"SELECT path, owner, '{n}' AS ind, {w} AS weight FROM c WHERE regexp_matches(call, '{_q(p)}')" for n, w, p, _ in E.RISKS)
_FUNCTIONS = "fn AS (SELECT path, node_id, exit, coalesce(name, 'anonymous') AS name, line, contains(text, 'async') AS is_async FROM n WHERE kind = 'Function')"
_IN_CATCH = "EXISTS (SELECT 1 FROM n c WHERE c.kind = 'Catch' AND c.path = x.path AND x.node_id > c.node_id AND x.node_id <= c.exit)"
_PROPAGATION = f"""th AS (SELECT path, owner, bool_or(true) AS throws, bool_or({_IN_CATCH}) AS rethrows FROM n x WHERE kind = 'Throw' GROUP BY 1, 2),
    ty AS (SELECT t.path, t.owner, regexp_extract(w.name, 'new\\s+([\\w.$]+)', 1) AS type FROM n t JOIN n w ON w.path = t.path AND w.parent_id = t.node_id AND w.kind = 'New' WHERE t.kind = 'Throw' UNION SELECT path, owner, 'Error' FROM n x WHERE kind = 'Identifier' AND regexp_matches(name, '^(e|err|error|ex|exception)\\.') AND {_IN_CATCH}),
    et AS (SELECT path, owner, list_sort(list(DISTINCT type)) AS types FROM ty WHERE type <> '' GROUP BY 1, 2),
    ah AS (SELECT DISTINCT path, owner FROM n x WHERE (kind = 'Await' AND EXISTS (SELECT 1 FROM n t WHERE t.kind = 'Try' AND t.path = x.path AND x.node_id > t.node_id AND x.node_id <= t.exit)) OR (kind = 'Call' AND regexp_matches(name, 'Promise\\.reject|\\.catch$|^catch$')))"""
_RISK = f"""{_N}, {_FUNCTIONS}, c AS (SELECT path, owner, replace(name, '?.', '.') AS call FROM n WHERE kind IN ('Call', 'New')), h AS (SELECT DISTINCT * FROM ({_HITS} UNION ALL SELECT path, owner, 'async', 2 FROM n WHERE kind = 'Await' UNION ALL SELECT path, node_id, 'async', 2 FROM fn WHERE is_async)),
    s AS (SELECT path, owner, sum(weight)::INT AS risk, list_sort(list(ind)) AS inds FROM h GROUP BY 1, 2), {_PROPAGATION},
    r AS (SELECT fn.path, fn.name, fn.line, coalesce(array_to_string(s.inds, ','), '') AS indicators, coalesce(s.risk, 0) AS risk, coalesce(th.throws, false) AS throws, coalesce(th.rethrows, false) AS rethrows, ah.path IS NOT NULL AS async_handling, coalesce(array_to_string(et.types, ','), '') AS error_types,
      EXISTS (SELECT 1 FROM n t WHERE t.kind = 'Try' AND t.path = fn.path AND t.owner = fn.node_id) AS tries, coalesce(list_contains(s.inds, 'server'), false) AS server
      FROM fn LEFT JOIN s ON s.path = fn.path AND s.owner = fn.node_id LEFT JOIN th ON th.path = fn.path AND th.owner = fn.node_id LEFT JOIN ah ON ah.path = fn.path AND ah.owner = fn.node_id LEFT JOIN et ON et.path = fn.path AND et.owner = fn.node_id),
    rr AS (SELECT path, name, line, indicators, risk, risk >= CASE WHEN contains(path, 'api/') THEN 1 WHEN server THEN 2 ELSE 3 END AS should_handle, tries OR throws OR async_handling OR error_types <> '' AS handled, throws, rethrows, async_handling, error_types FROM r)"""


def _risks(spark: SparkSession) -> DataFrame:
    return E.risks(_nodes(spark))


@query("error_handling", f"WITH {_RISK} SELECT * FROM rr")
def error_handling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk, handling and propagation of each function."""
    r = _risks(spark)
    return r.select("path", "name", "line", F.array_join("indicators", ",").alias("indicators"), "risk", "should_handle", "handled", "throws", "rethrows", "async_handling", F.array_join("error_types", ",").alias("error_types"))


@query("error_gaps", f"WITH {_RISK} SELECT path, name, line, risk, row_number() OVER (PARTITION BY path ORDER BY risk DESC, line, name)::INT AS place FROM rr WHERE should_handle AND NOT handled")
def error_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gaps(_risks(spark))


_SCOPE = """CASE kind WHEN 'JsxAttribute' THEN CASE WHEN regexp_matches(name, '^on[A-Z]') THEN 'event' END WHEN 'JsxElement' THEN 'render' WHEN 'JsxExpression' THEN 'render'
    WHEN 'Call' THEN CASE WHEN name IN ('useEffect', 'useLayoutEffect', 'useInsertionEffect') THEN 'effect' WHEN name IN ('useCallback', 'useMemo') THEN 'other' WHEN regexp_matches(name, '^use[A-Z]') THEN 'effect' WHEN regexp_matches(name, '(add|remove)EventListener$|\\.(on|off)$') THEN 'event' END
    WHEN 'Property' THEN CASE WHEN regexp_matches(name, '^(on|handle)[A-Z]') THEN 'event' END
    WHEN 'Function' THEN CASE WHEN regexp_matches(name, '^(on|handle)[A-Z]') THEN 'event' WHEN name = 'render' THEN 'render' WHEN name IN ('componentDidMount', 'componentDidUpdate', 'componentWillUnmount') THEN 'effect' WHEN regexp_matches(name, '^[A-Z]') THEN 'render' END END"""
_LOG = _q(E.LOGGING)


@query(
    "try_blocks",
    f"""WITH {_N}, a AS (SELECT path, node_id, exit, parent_id, kind, {_SCOPE} AS scope FROM n), v AS (SELECT * FROM a WHERE scope IS NOT NULL AND NOT (kind = 'JsxExpression' AND EXISTS (SELECT 1 FROM n p WHERE p.path = a.path AND p.node_id = a.parent_id AND p.kind = 'JsxAttribute'))),
    t AS (SELECT t.path, t.node_id, t.line, t.exit, c.node_id AS c, c.exit AS c_exit FROM n t JOIN n c ON c.path = t.path AND c.parent_id = t.node_id AND c.kind = 'Catch' WHERE t.kind = 'Try')
    SELECT path, line, coalesce((SELECT arg_max(v.scope, v.node_id) FROM v WHERE v.path = t.path AND t.node_id > v.node_id AND t.node_id <= v.exit), 'other') AS scope, coalesce((SELECT bool_or(kind = 'Call' AND regexp_matches(name, '{_LOG}')) FROM n WHERE n.path = t.path AND n.node_id > t.c AND n.node_id <= t.c_exit), false) AS logs,
    coalesce((SELECT bool_or(kind = 'JsxElement') FROM n WHERE n.path = t.path AND n.node_id > t.c AND n.node_id <= t.c_exit), false) AS renders, coalesce((SELECT array_to_string(list_sort(list(DISTINCT name)), ',') FROM n WHERE n.path = t.path AND n.node_id > t.c AND n.node_id <= t.c_exit AND kind = 'Call' AND regexp_matches(name, '^set[A-Z]')), '') AS updates,
    (SELECT count(*) FROM n o WHERE o.kind = 'Try' AND o.path = t.path AND t.node_id > o.node_id AND t.node_id <= o.exit) AS nested FROM t""",
)
def try_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.try_blocks(_nodes(spark)).select("path", "line", "scope", "logs", "renders", F.array_join("updates", ",").alias("updates"), "nested")


_LIBRARY = "CASE i.name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.BOUNDARIES.items()) + " END"


@query(
    "error_boundaries",
    f"""WITH {_N}, m AS (SELECT c.path, c.node_id AS c, c.line, f.name AS method, f.node_id AS m, f.exit AS m_exit FROM n c JOIN n f ON f.path = c.path AND f.parent_id = c.node_id AND f.kind = 'Function' WHERE c.kind = 'Class'), b AS (SELECT DISTINCT path, c FROM m WHERE method IN ('componentDidCatch', 'getDerivedStateFromError')),
    x AS (SELECT m.*, n.kind, coalesce(n.name, '') AS name FROM m JOIN b USING (path, c) LEFT JOIN n ON n.path = m.path AND n.node_id > m.m AND n.node_id <= m.m_exit),
    f AS (SELECT path, line, 'error-logging' AS f FROM x WHERE method = 'componentDidCatch' UNION SELECT path, line, 'external-logging' FROM x WHERE method = 'componentDidCatch' AND kind = 'Call' AND regexp_matches(name, 'Sentry|captureException') UNION SELECT path, line, 'console-logging' FROM x WHERE method = 'componentDidCatch' AND kind = 'Call' AND contains(name, 'console.error')
      UNION SELECT path, line, 'state-update' FROM x WHERE method = 'getDerivedStateFromError' UNION SELECT path, line, 'fallback-ui' FROM x WHERE method = 'render' AND kind = 'JsxElement' UNION SELECT path, line, 'conditional-render' FROM x WHERE method = 'render' AND kind = 'Conditional')
    SELECT path, line, 'custom-class' AS library, array_to_string(list_sort(list(f)), ',') AS features FROM f GROUP BY 1, 2 UNION ALL
    SELECT t.path, t.line, {_LIBRARY}, '' FROM n t JOIN n s ON s.path = t.path AND s.kind = 'ImportName' AND s.name = split_part(t.name, '.', 1) JOIN n i ON i.path = s.path AND i.node_id = s.parent_id WHERE t.kind = 'JsxElement' AND {_LIBRARY} IS NOT NULL AND regexp_matches(t.name, 'Boundary|Reset') UNION ALL
    SELECT path, 1, 'Next.js', 'app-router' FROM n WHERE kind = 'Program' AND regexp_matches(path, '(^|/)app/(.*/)?(global-)?error\\.[jt]sx?$')""",
)
def error_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nodes(spark)
    return E.boundaries(n, M.bound_names(n)).select("path", "line", "library", F.array_join("features", ",").alias("features"))


_ERR = "(?i)err|fail|exception|invalid"


@query(
    "error_patterns",
    f"""WITH {_N}, c AS (SELECT path, line, name FROM n WHERE kind IN ('Call', 'New')) SELECT path, line, 'error-logging' AS pattern FROM c WHERE regexp_matches(name, '{_LOG}') UNION ALL SELECT path, line, 'state-update' FROM c WHERE regexp_matches(name, '^set\\w*(Error|Failed|Invalid)|^(dispatch|setError)$')
    UNION ALL SELECT path, line, 'browser-api' FROM c WHERE regexp_matches(name, '{_q(E.BROWSER)}') UNION ALL SELECT path, line, 'form-validation' FROM c WHERE regexp_matches(name, '{_q(E.FORMS)}') UNION ALL SELECT path, line, 'async-handling' FROM c WHERE regexp_matches(name, '\\.catch$|Promise\\.(reject|allSettled)|^catch$')
    UNION ALL SELECT DISTINCT x.path, x.line, 'conditional-render' FROM n x JOIN n r ON r.path = x.path AND r.parent_id = x.parent_id AND r.node_id < x.node_id AND r.kind = 'Identifier' AND regexp_matches(r.name, '{_ERR}') WHERE x.kind IN ('Conditional', 'Logical')""",
)
def error_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.patterns(_nodes(spark))


_STATE = "CASE " + " ".join(f"WHEN regexp_matches(c.name, '{p}') THEN '{k}'" for k, p in E.STATES) + " END"


@query("error_states", f"WITH {_N} SELECT c.path, c.line, {_STATE} AS kind, v.name AS variable FROM n c JOIN n v ON v.path = c.path AND v.node_id = c.parent_id AND v.kind = 'Variable' WHERE c.kind = 'Call' AND {_STATE} IS NOT NULL AND regexp_matches(v.name, '{_ERR}')")
def error_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.error_states(_nodes(spark))


def _fallback_sql() -> str:
    out = []
    for kind, tag, attribute in E.FALLBACKS:
        by = f"regexp_matches(t.name, '{tag}')"
        if attribute != "^$":
            by += f" OR EXISTS (SELECT 1 FROM n a WHERE a.path = t.path AND a.parent_id = t.node_id AND a.kind = 'JsxAttribute' AND (regexp_matches(a.name, '{attribute}') OR regexp_matches(a.text, '[''\"]({attribute})[''\"]')))"
        out.append(f"WHEN {by} THEN '{kind}'")
    return "CASE " + " ".join(out) + " END"


@query("fallback_elements", f"WITH {_N}, k AS (SELECT path, line, name AS tag, {_fallback_sql()} AS kind FROM n t WHERE t.kind = 'JsxElement') SELECT * FROM k WHERE kind IS NOT NULL")
def fallback_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fallback_elements(C.elements(_nodes(spark))).drop("node_id")


FACTS = [("src/a.tsx", 0, 0, 0, 0, 1, 0), ("src/b.tsx", 1, 0, 0, 0, 0, 0), ("src/c.tsx", 0, 1, 0, 0, 0, 0), ("src/d.tsx", 0, 0, 1, 0, 0, 0), ("src/e.tsx", 0, 0, 1, 2, 0, 0), ("src/app/page.tsx", 0, 0, 0, 0, 0, 1), ("src/f.tsx", 0, 0, 0, 0, 2, 3), ("src/g.tsx", 0, 0, 0, 0, 0, 0)]
_FACT = "path, boundaries, tries, states, fallbacks, patterns, functions"
_SIGNIFICANT = f"""{named("f", FACTS, _FACT)}, g AS (SELECT *, (regexp_matches(path, '(^|/)(layout|page|error|_app|_document|_error)\\.[^/]*$') AND (states > 0 OR functions > 0)) OR (boundaries > 0)::INT + (tries > 0)::INT + (states > 0)::INT + (fallbacks > 0)::INT + (patterns > 0)::INT + (functions > 0)::INT >= 2 OR boundaries > 0 OR tries > 0 AS significant FROM f)"""


def _significant(spark: SparkSession) -> DataFrame:
    return E.significant(spark.createDataFrame(FACTS, _FACT.replace(",", " int,").replace("path int", "path string") + " int"))


@query("error_significance", f"WITH {_SIGNIFICANT} SELECT path, significant FROM g")
def error_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _significant(spark).select("path", "significant")


HANDLED = [("a", 6, True, True), ("b", 5, True, False), ("c", 3, True, False), ("d", 1, True, False), ("e", 2, False, True), ("f", 0, False, False)]


@query(
    "error_summary",
    f"""WITH {_SIGNIFICANT}, {named("h", HANDLED, "name, risk, should_handle, handled")} SELECT count(*) AS components, count_if(significant) AS with_handling, floor(100.0 * count_if(significant) / count(*) * 100 + 0.5) / 100 AS coverage, sum(CASE WHEN significant THEN boundaries END)::BIGINT AS boundaries, sum(CASE WHEN significant THEN tries END)::BIGINT AS tries,
    (SELECT count_if(handled) FROM h) AS functions_handled, (SELECT count_if(should_handle) FROM h) AS functions_needing, (SELECT count_if(should_handle AND NOT handled) FROM h) AS functions_missing, (SELECT count_if(should_handle AND risk >= 5) FROM h) AS high, (SELECT count_if(should_handle AND risk BETWEEN 3 AND 4) FROM h) AS medium, (SELECT count_if(should_handle AND risk < 3) FROM h) AS low FROM g""",
)
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summary(_significant(spark), spark.createDataFrame(HANDLED, "name string, risk int, should_handle boolean, handled boolean"))


KEPT = [("src/a.ts", True, False, 0, 0), ("src/a.ts", False, True, 4, 1), ("src/a.ts", False, True, 3, 2), ("src/app/a.ts", False, False, 1, 2), ("src/api/a.ts", False, False, 1, 1), ("src/a.ts", False, False, 3, 3)]


@query("error_functions_kept", f"WITH {named('k', KEPT, 'path, handled, should_handle, risk, n')} SELECT path, risk, n, handled OR (should_handle AND risk >= 4) OR n >= CASE WHEN contains(path, '/api/') OR contains(path, '/app/') THEN 2 ELSE 3 END AS kept FROM k")
def error_functions_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.createDataFrame(KEPT, "path string, handled boolean, should_handle boolean, risk int, n int")
    return k.select("path", "risk", "n", E.kept_function(F.col("handled"), F.col("should_handle"), F.col("risk"), F.col("n"), F.col("path")).alias("kept"))


@query("error_rollup")
def error_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of a project by file; a test holds it against counts made by hand."""
    n = _nodes(spark)
    return E.component_rollup(C.components(n), E.risks(n), E.try_blocks(n), E.boundaries(n, M.bound_names(n)), E.error_states(n), E.fallback_elements(C.elements(n)), E.patterns(n))


@query(
    "boundary_libraries",
    f"WITH {named('b', [('x', 'Sentry'), ('y', 'Sentry'), ('z', 'custom-class')], 'path, library')} SELECT library, count(*) AS n FROM b GROUP BY 1",
)
def boundary_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.library_usage(spark.createDataFrame([("x", "Sentry"), ("y", "Sentry"), ("z", "custom-class")], "path string, library string"))
