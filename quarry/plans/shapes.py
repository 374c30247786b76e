"""Types over a small project's syntax nodes and over literal types, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import code as C
from quarry.operators import shapes as T
from quarry.plans.common import named, node_table
from quarry.registry import query
from quarry.sources import syntax

#: Types: path, name, kind, head, properties, methods (names and types joined by commas).
TYPES = [
    ("src/types/user.ts", "User", "Interface", "", "id:string,name:string", ""), ("src/types/person.ts", "Person", "Interface", "", "id:string,name:string", ""), ("src/api/user.ts", "UserProps", "Interface", "", "id:string,name:string", ""),
    ("src/api/row.ts", "UserRow", "Interface", "", "id:string,name:string", ""), ("src/a.ts", "Long", "Interface", "", "a:x,b:x,c:x,d:x", "go:void"), ("src/b.ts", "Longer", "Interface", "", "a:x,b:x,c:y", ""), ("src/c.ts", "Other", "Interface", "", "z:x", ""),
    ("src/d.ts", "Kind", "TypeAlias", "'a' | 'b' | 'c' | 'd'", "", ""), ("src/e.ts", "Sort", "TypeAlias", "'a'|'b'|'c'|'d'", "", ""), ("src/f.ts", "Wide", "TypeAlias", "A | B | C | D | E | F | null", "", ""), ("src/g.ts", "Both", "TypeAlias", "A & { x: number }", "", ""),
    ("src/h.ts", "Deep", "TypeAlias", "{ a: { b: { c: string } } }", "", ""), ("src/i.ts", "Some", "TypeAlias", "Partial<User>", "", ""), ("src/j.ts", "Name", "TypeAlias", "string", "", ""), ("src/k.ts", "Color", "Enum", "", "Red:,Blue:", ""), ("src/l.ts", "Props", "Interface", "", "q:any", ""), ("src/m.ts", "MyState", "Class", "", "w:any", ""),
    ("src/types/z.ts", "Zed", "TypeAlias", "z.infer<typeof zed>", "", ""), ("src/types/y.ts", "Zod", "TypeAlias", "z.infer<typeof zed>", "", ""),
]
_COLUMNS = "path, name, kind, head, properties, methods"


def _types(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(TYPES, _COLUMNS.replace(",", " string,") + " string")
    split = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return rows.withColumns({"properties": split("properties"), "methods": split("methods")})


_T = named("t", TYPES, _COLUMNS)
_MEMBERS = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, ',')) END"
_UNION = "len(list_filter(list_transform(string_split({0}, '|'), lambda x: trim(x)), lambda x: x <> ''))"
_FLAT = "regexp_replace(regexp_replace(regexp_replace(head, '\\{[^{}]*\\}|<[^<>]*>', '_', 'g'), '\\{[^{}]*\\}', '_', 'g'), '\\{[^{}]*\\}', '_', 'g')"
_KEYED = f"""{_T}, u AS (SELECT *, {_MEMBERS.format('properties')} + {_MEMBERS.format('methods')} AS n, {_FLAT} AS flat FROM t), v AS (SELECT *, {_UNION.format('flat')} AS parts FROM u),
    k AS (SELECT *, kind || '|' || CASE WHEN n > 0 THEN array_to_string(list_sort(string_split(properties, ',')), ',') || ';' || methods ELSE regexp_replace(head, '\\s+', '', 'g') END AS shape,
    CASE kind WHEN 'TypeAlias' THEN CASE WHEN NOT starts_with(head, '{{') AND parts > 1 THEN CASE WHEN parts <= 3 THEN 'simple-union' WHEN parts <= 7 THEN 'medium-union' ELSE 'complex-union' END WHEN starts_with(head, '{{') THEN 'simple-object' ELSE 'simple-alias' END
      WHEN 'Interface' THEN CASE WHEN n <= 3 THEN 'simple-interface' WHEN n <= 10 THEN 'medium-interface' ELSE 'complex-interface' END WHEN 'Enum' THEN 'simple-enum' ELSE 'unknown' END AS size_class,
    CASE WHEN contains(path, '/types/') THEN 'types-dir' WHEN contains(path, '/components/') THEN 'components-dir' WHEN contains(path, '/api/') THEN 'api-dir' WHEN contains(path, '/utils/') THEN 'utils-dir' ELSE 'other' END AS place FROM v),
    g AS (SELECT shape, size_class, place, count(*) AS n, count(DISTINCT name) AS n_names, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS n_folders, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM k GROUP BY 1, 2, 3 HAVING count(*) > 1)"""


@query("type_classes", f"WITH {_KEYED} SELECT path, name, size_class, place FROM k")
def type_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.keyed(_types(spark)).select("path", "name", "size_class", "place")


@query("duplicate_types", f"WITH {_KEYED} SELECT names, n, n_names, n_folders FROM g")
def duplicate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of one shape, size and place."""
    return T.duplicate_groups(_types(spark)).select(F.array_join("names", ",").alias("names"), "n", "n_names", "n_folders")


USED = [("src/types/user.ts", "User", 1), ("src/types/person.ts", "Person", 4), ("src/api/user.ts", "UserProps", 9), ("src/api/row.ts", "UserRow", 9)]


@query(
    "primary_types",
    f"""WITH {_KEYED}, {named("s", USED, "path, name, used")} SELECT k.name, k.path, row_number() OVER (PARTITION BY k.shape, k.size_class, k.place ORDER BY regexp_matches(k.path, '/(types|shared)/') DESC, contains(head, 'z.infer'), coalesce(used, 0) DESC, regexp_matches(k.name, '{T.SPECIFIC}'), k.name, k.path) = 1 AS "primary"
    FROM k JOIN g ON g.shape = k.shape AND g.size_class = k.size_class AND g.place = k.place AND g.n_names > 1 LEFT JOIN s ON s.path = k.path AND s.name = k.name""",
)
def primary_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.primaries(_types(spark), spark.createDataFrame(USED, "path string, name string, n int")).drop("group")


PAIRS = [("A", "B", "id name mail", "id name", "save", ""), ("C", "D", "x", "y z", "", "m"), ("E", "F", "", "", "", "")]


@query(
    "property_overlap",
    f"""WITH {named("p", PAIRS, "a, b, pa, pb, ma, mb")}, s AS (SELECT a, b, list_filter(string_split(pa, ' '), lambda x: x <> '') AS x, list_filter(string_split(pb, ' '), lambda x: x <> '') AS y, list_filter(string_split(ma, ' '), lambda x: x <> '') AS u, list_filter(string_split(mb, ' '), lambda x: x <> '') AS v FROM p)
    SELECT a, b, array_to_string(list_sort(list_intersect(x, y)), ',') AS common, array_to_string(list_sort(list_filter(x, lambda e: NOT list_contains(y, e))), ',') AS only_a, array_to_string(list_sort(list_filter(y, lambda e: NOT list_contains(x, e))), ',') AS only_b, len(list_filter(y, lambda e: NOT list_contains(x, e))) + len(list_filter(v, lambda e: NOT list_contains(u, e))) = 0 AS a_is_subtype FROM s""",
)
def property_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    rows = spark.createDataFrame(PAIRS, "a string, b string, pa string, pb string, ma string, mb string")
    o = T.overlap(rows.select("a", "b", *(split(c).alias(c) for c in ("pa", "pb", "ma", "mb"))))
    return o.select("a", "b", *(F.array_join(c, ",").alias(c) for c in ("common", "only_a", "only_b")), "a_is_subtype")


_SIMILAR = f"""{_T}, p AS (SELECT path || '#' || name AS id, path, name, kind, list_sort(list_transform(string_split(properties, ','), lambda x: split_part(x, ':', 1))) AS ps FROM t WHERE properties <> ''), e AS (SELECT *, count(*) OVER (PARTITION BY ps) AS n, min(id) OVER (PARTITION BY ps) AS head FROM p),
    r AS (SELECT * FROM e WHERE n = 1), l AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.kind = b.kind AND a.id <> b.id WHERE len(list_intersect(a.ps, b.ps)) > 0.5 * len(list_distinct(list_concat(a.ps, b.ps)))), w AS (SELECT a AS node, a AS other FROM l UNION SELECT w.node, l.b FROM w JOIN l ON l.a = w.other)"""


@query("similar_types", f'WITH RECURSIVE {_SIMILAR} SELECT path, name, head AS "group", true AS exact FROM e WHERE n > 1 UNION ALL SELECT split_part(node, \'#\', 1), split_part(node, \'#\', 2), min(other), false FROM w GROUP BY node')
def similar_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.similar_groups(_types(spark))


MEMBERS = [("src/types/user.ts", "User", "g1"), ("src/types/person.ts", "Person", "g1"), ("src/a.ts", "Long", "g2"), ("src/b.ts", "Longer", "g2")]


@query(
    "unified_types",
    f"""WITH {_T}, {named("m", MEMBERS, "path, name, grp")}, f AS (SELECT grp, split_part(p, ':', 1) AS field, split_part(p, ':', 2) AS type FROM (SELECT grp, unnest(string_split(properties, ',')) AS p FROM m JOIN t USING (path, name))), x AS (SELECT grp, field, string_agg(DISTINCT type, ' | ' ORDER BY type) AS type FROM f GROUP BY 1, 2)
    SELECT grp AS "group", CASE grp WHEN 'g1' THEN 'PersonBase' ELSE 'LongBase' END AS suggested, (SELECT string_agg(field || ':' || type, '; ' ORDER BY field) FROM x WHERE x.grp = m.grp) AS properties, CASE grp WHEN 'g1' THEN 'src/types' ELSE 'src/types' END AS folder, count(*) AS n FROM m GROUP BY grp""",
)
def unified_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One type for each group; names and folders in the SQL are given by hand."""
    return T.unified(spark.createDataFrame(MEMBERS, "path string, name string, group string"), _types(spark))


#: What reading the aliases gives: name, form, members, depth, broad, simplify.
COMPLEX = [("Kind", "union", 4, 0, False, True), ("Sort", "union", 4, 0, False, True), ("Wide", "union", 7, 0, True, True), ("Both", "intersection", 2, 1, False, False), ("Deep", "literal", 1, 3, False, True), ("Some", "wrapper", 1, 0, False, False)]


@query("complex_types", f"WITH {named('c', COMPLEX, 'name, form, members, depth, broad, simplify')} SELECT * FROM c")
def complex_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.complex_types(_types(spark)).drop("path")


SOURCES = [
    ("src/types.ts", "export interface User { id: string; owner: User; extra: any }\nexport type Role = 'a' | 'b';\nexport enum Level { Low, High }\ninterface Props { x: number }\n"),
    ("src/a.tsx", "import { User, Role } from './types';\nexport function Card({ user }: { user: User }) { return <p />; }\nexport function Bare({ user }) { return <p />; }\nexport function role(u: User): Role { return 'a'; }\nexport function loose(u) { return u; }\nclass Admin extends Level { data: any; }\n"),
]


def _nodes(spark: SparkSession) -> DataFrame:
    return syntax.nodes(spark.createDataFrame(SOURCES, "path string, content string"))


_N = node_table(SOURCES)
_WORDS = f"""{_N}, x AS (SELECT path, CASE WHEN kind IN ('Property', 'Method', 'Parameter', 'TypeAlias', 'Interface', 'Class') THEN text WHEN kind = 'Variable' THEN regexp_replace(text, '^(const|let|var)', '') WHEN kind = 'ReturnType' THEN name END AS s FROM n),
    w AS (SELECT path, word, count(*) AS n FROM (SELECT path, unnest(regexp_extract_all(coalesce(s, ''), '[A-Za-z_$][\\w$]*')) AS word FROM x) GROUP BY 1, 2), ty AS (SELECT DISTINCT path, name FROM n WHERE kind IN ('Interface', 'TypeAlias', 'Enum', 'Class')), us AS (SELECT ty.path, ty.name, (SELECT count(DISTINCT w.path) FROM w WHERE w.word = ty.name AND w.path <> ty.path) AS n FROM ty)"""


@query("type_usage", f"WITH {_WORDS} SELECT * FROM us")
def type_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nodes(spark)
    return T.usage(C.type_definitions(n), T.type_words(n))


@query("unused_types", f"WITH {_WORDS} SELECT path, name FROM us WHERE n = 0")
def unused_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nodes(spark)
    return T.unused(T.usage(C.type_definitions(n), T.type_words(n)))


@query("any_uses", f"WITH {_WORDS} SELECT path, n FROM w WHERE word = 'any'")
def any_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.any_uses(T.type_words(_nodes(spark)))


@query("generic_type_names", f"WITH {_T} SELECT path, name FROM t WHERE name IN ({', '.join(repr(g) for g in T.GENERIC)}) OR (regexp_matches(name, '(Props|State)$') AND length(name) < 10)")
def generic_type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.generic_names(_types(spark))


@query(
    "component_typing",
    f"""WITH {_N}, f AS (SELECT path, node_id, name, exists(SELECT 1 FROM n j WHERE j.path = n.path AND j.kind = 'JsxElement' AND j.node_id > n.node_id AND j.node_id <= n.exit) AND regexp_matches(name, '^[A-Z]') AS is_component FROM n WHERE kind = 'Function' AND name IS NOT NULL)
    SELECT path, name, is_component, CASE WHEN is_component AND (SELECT count(*) FROM n p WHERE p.path = f.path AND p.parent_id = f.node_id AND p.kind = 'Parameter') > 0 THEN (SELECT bool_or(coalesce(p.text, '') <> '') FROM n p WHERE p.path = f.path AND p.parent_id = f.node_id AND p.kind = 'Parameter') END AS typed_props,
    NOT is_component AND NOT EXISTS (SELECT 1 FROM n p WHERE p.path = f.path AND p.parent_id = f.node_id AND p.kind = 'ReturnType') AS untyped_result FROM f""",
)
def component_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nodes(spark)
    return T.component_typing(C.functions(n), C.components(n))


@query("type_suggestions")
def type_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences for all findings on types; a test reads some."""
    n, types = _nodes(spark), _types(spark)
    words = T.type_words(n)
    return T.suggestions(T.duplicate_groups(types), T.complex_types(types), T.unused(T.usage(C.type_definitions(n), words)), T.any_uses(words))
