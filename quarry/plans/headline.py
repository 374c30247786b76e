"""The headline score of components over literal facts, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import score_parts as S
from quarry.operators import scoring
from quarry.plans.common import values
from quarry.registry import query

_LONG = "import x\n" + "const a = async () => { await f(); await g(); await h(); await i(); };\n" * 3 + "useEffect(() => {}); " * 5 + "useState(0); " * 7 + "a ? b : c; " * 5 + "useCartStore(); useUserStore(); useAStore(); useBStore();\n" * 2 + "{a {b} c} " * 4 + "\n" * 160
_BOX = "useEffect(() => {}); useEffect(() => {}); useEffect(() => {}); fetch('/a'); fetch('/b'); fetch('/c');\n" + "return <div><p><b><i><u><a><ul><li><h1><h2><h3><h4></h4></h3></h2></h1></li></ul></a></u></i></b></p></div>\n"
#: What differs from "nothing found", by component.
GIVEN: tuple[dict[str, object], ...] = (
    {"name": "Home", "path": "src/app/page.tsx", "content": "export function generateMetadata() {}\n", "cyclomatic": 3.0, "cognitive": 2.0, "maintainability": 80.0, "coupling": 0.5, "has_meta": True, "title_length": 40, "description_length": 130, "has_open_graph": True, "images": 4, "missing_alt": 0, "in_flow": True, "conditionals": 2, "flow_depth": 2},
    {"name": "ReportContainer", "path": "src/components/ReportContainer.tsx", "content": _LONG + _BOX, "cyclomatic": 14.0, "cognitive": 30.0, "maintainability": 22.5, "coupling": 0.93, "risky": 4, "risky_handled": 0, "risky_severe": 3, "unhandled_points": 350.0, "fallbacks": 1, "untyped_props": True, "any_uses": 3, "complex_types": 4, "untyped_returns": 2, "interfaces": 1, "in_flow": True, "conditionals": 7, "flow_depth": 5},
    {"name": "Ring", "path": "src/components/Ring.tsx", "cycle_size": 4, "cycle_critical": True, "zombie_size": 6, "zombie_risk": "high", "cyclomatic": 8.0, "cognitive": 5.0, "maintainability": 49.0, "interfaces": 2, "props": 3, "handling": 2, "risky": 2, "risky_handled": 2, "similarity": 0.91, "missing_keys": 4, "duplicate_values": 3},
    {"name": "LegacyPage", "path": "web/pages/legacy.tsx", "content": "x", "has_meta": True, "title_length": 10, "description_length": 0, "heading_issues": 2, "images": 5, "missing_alt": 2, "aria_misuse": 2, "inputs": 4, "unlabelled": 3, "not_lazy": 1, "images_not_lazy": 5, "heavy_imports": 1, "vitals": 2, "missing_keys": 20, "magic_numbers": 9, "comment_ratio": 0.05},
    {"name": "appConfig", "path": "src/config/appConfig.ts", "any_uses": 2, "magic_numbers": 30, "missing_keys": 3},
    {"name": "useThing", "path": "src/hooks/useThing.ts", "cyclomatic": 6.0, "cognitive": 9.0, "coupling": 0.8, "unhandled_points": 50.0, "risky": 1},
    {"name": "formatDate", "path": "src/utils/formatDate.ts", "cycle_size": 2, "untyped_returns": 5, "zombie_size": 2, "zombie_risk": "low"},
    {"name": "User.types", "path": "src/types/User.types.ts", "complex_types": 3, "interfaces": 4},
)
_ROWS = [tuple(g.get(c, empty) for c, (_, empty) in S.FACTS.items()) for g in GIVEN]
_SCHEMA = ", ".join(f"{c} {kind}" for c, (kind, _) in S.FACTS.items())
_TYPES = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN"}
_FACTS = "f AS (SELECT " + ", ".join(f"CAST({c} AS {_TYPES[kind]}) AS {c}" for c, (kind, _) in S.FACTS.items()) + f" FROM {values(_ROWS, ', '.join(S.FACTS))})"


def _facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ROWS, _SCHEMA)


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(content, '{pattern}'))"


_LINES = "len(string_split(content, chr(10)))"
_PAGE = "(contains(path, '/pages/') OR contains(path, '/app/') OR contains(path, 'page.') OR contains(lower(name), 'page'))"
_KIND = """CASE WHEN regexp_matches(lower(name), 'constant|config') OR regexp_matches(lower(path), '/constants/|/config/') THEN 'constants'
    WHEN regexp_matches(lower(name), '\\.config|configuration|rc$') OR contains(lower(path), 'config.') THEN 'config'
    WHEN regexp_matches(lower(name), '\\.type|interface|schema') OR contains(lower(path), '/types/') THEN 'types'
    WHEN contains(lower(path), '/pages/') OR (contains(lower(path), '/app/') AND contains(lower(path), 'page.')) THEN 'page'
    WHEN starts_with(lower(name), 'use') AND length(name) > 3 THEN 'hook'
    WHEN regexp_matches(lower(path), '/utils/|/helpers/|/lib/') OR contains(lower(name), 'util') THEN 'utility' ELSE 'component' END"""
_WORK = " + ".join(f"CASE WHEN {_n(p)} > 2 THEN {_n(p)} * 8 ELSE 0 END" for p in (r"useEffect\s*\(", r"useState\s*[<(]", r"async\s+", r"setInterval\s*\(", r"setTimeout\s*\(", r"fetch\s*\(", r"axios\."))
#: Each sub-score, written from its rule.
_SQL = {
    "circular": "CASE WHEN cycle_size = 0 THEN 0 ELSE floor(100 * CASE WHEN cycle_critical THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END * least(cycle_size / 5, 1) + 0.5) END",
    "error_handling": "least(100, floor(unhandled_points + CASE WHEN fallbacks > 0 AND boundaries = 0 THEN 40 ELSE 0 END + CASE WHEN risky_severe > 0 AND risky_handled = 0 THEN 50 ELSE 0 END + CASE WHEN risky > 0 THEN (risky - risky_handled) / risky * 60 ELSE 0 END + 0.5))",
    "cyclomatic": "floor(least(cyclomatic / 8 * 50, 50) + least(cognitive / 12 * 50, 50) + 0.5)",
    "cognitive": "0",
    "maintainability": "CASE WHEN maintainability < 50 THEN floor((50 - maintainability) / 50 * 100 + 0.5) ELSE 0 END",
    "types": "floor(greatest(0, CASE WHEN untyped_props THEN 50 ELSE 0 END + CASE WHEN any_uses > 1 THEN least(any_uses * 15, 40) ELSE 0 END + CASE WHEN complex_types > 2 THEN 25 ELSE 0 END + least(untyped_returns * 10, 30) - CASE WHEN interfaces > 0 AND NOT untyped_props THEN 15 ELSE 0 END) + 0.5)",
    "accessibility": "least(100, floor(least(missing_alt / 3 * 40, 40) + least(aria_misuse * 10, 30) + CASE WHEN inputs > 0 AND unlabelled / inputs > 0.1 THEN unlabelled / inputs * 50 ELSE 0 END + CASE WHEN contains(path, '/pages/') OR contains(path, 'layout') THEN CASE WHEN mains = 0 THEN 20 ELSE 0 END + CASE WHEN headers = 0 THEN 15 ELSE 0 END + CASE WHEN navs = 0 THEN 10 ELSE 0 END ELSE 0 END + 0.5))",
    "performance": "least(100, 25 * not_lazy + CASE WHEN images_not_lazy > 3 THEN least(images_not_lazy * 10, 30) ELSE 0 END + least(heavy_imports * 20, 40) + vitals * 15)",
    "seo": f"CASE WHEN {_PAGE} AND coalesce(contains(content, 'generateMetadata') AND {_LINES} < 50, false) THEN 0 ELSE least(100, 8 * heading_issues + CASE WHEN {_PAGE} AND has_meta THEN CASE WHEN title_length = 0 THEN 30 WHEN title_length > 70 OR title_length < 20 THEN 10 ELSE 0 END + CASE WHEN description_length = 0 THEN 30 WHEN description_length > 180 OR description_length < 100 THEN 10 ELSE 0 END + CASE WHEN has_open_graph THEN 0 ELSE 15 END ELSE 0 END) END",
    "coupling": "floor(least(coupling / 0.85::DOUBLE * 100, 100) + 0.5)",
    "zombie": "CASE WHEN zombie_size = 0 THEN 0 ELSE floor(100 * CASE zombie_risk WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END * least(zombie_size / 10, 1) + 0.5) END",
    "translation": "least(100, floor(CASE WHEN missing_keys > 15 THEN 60 ELSE missing_keys / 15 * 60 END + 5 * duplicate_values + 0.5))",
    "flow": "CASE WHEN in_flow THEN floor(CASE WHEN conditionals > 4 THEN 40 ELSE conditionals / 4 * 40 END + CASE WHEN flow_depth > 3 THEN 30 ELSE 0 END + 0.5) ELSE 0 END",
    "duplication": "CASE WHEN similarity > 0.8::DOUBLE THEN floor(similarity * 100 + 0.5) ELSE 0 END",
    "code_metrics": "CASE WHEN comment_ratio < 0.1::DOUBLE THEN 30 ELSE 0 END",
    "magic_numbers": "floor(least(magic_numbers / 15 * 100, 100) + 0.5)",
    "react": "coalesce(least(100, floor(" + " + ".join([
        f"15 * greatest(0, {_n(r'useEffect\s*\(')} - 3)", f"8 * greatest(0, {_n(r'useState\s*[<(]')} - 5)", f"10 * greatest(0, {_n(r'\?\s*[^:]*:')} - 3)",
        f"CASE WHEN {_n(r'\{\s*[^}]*\{[^}]*\}[^}]*\}')} > 2 THEN 8 * {_n(r'\{\s*[^}]*\{[^}]*\}[^}]*\}')} ELSE 0 END", f"0.3::DOUBLE * greatest(0, {_LINES} - 150)",
        f"CASE WHEN ({_n(r'async\s+')} > 2 OR {_n(r'await\s+')} > 3) AND {_n(r'try\s*\{')} = 0 THEN 25 ELSE 0 END", f"12 * greatest(0, {_n(r'use\w*Store\s*\(')} - 3)",
    ]) + " + 0.5)), 0)",
    "container": f"CASE WHEN content IS NOT NULL AND (regexp_matches(name, '(Container|Provider|Wrapper|Manager|Controller)$') OR contains(path, 'container')) THEN least(100, {_WORK} + 2 * greatest(0, {_n(chr(60) + chr(92) + 'w')} - 10)) ELSE 0 END",
}
_PARTS = "p AS (SELECT *, " + ", ".join(f"({e})::DOUBLE AS s_{k}" for k, e in _SQL.items()) + f", {_KIND} AS kind FROM f)"
_MELT = "(SELECT name, part, score FROM (" + " UNION ALL ".join(f"SELECT name, '{k}' AS part, s_{k} AS score FROM p" for k in _SQL) + "))"


@query("score_parts", f"WITH {_FACTS}, {_PARTS} SELECT name, part, score FROM {_MELT}")
def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eighteen sub-scores, a row each."""
    parts = F.array(*(F.struct(F.lit(k).alias("part"), s.cast("double").alias("score")) for k, s in S.sub_scores().items()))
    return _facts(spark).select("name", F.explode(parts).alias("x")).select("name", "x.part", "x.score")


@query("file_kinds", f"WITH {_FACTS} SELECT name, path, {_KIND} AS kind FROM f")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark).select("name", "path", S.file_kind(F.col("name"), F.col("path")).alias("kind"))


_RAW = values([(k, w) for k, w in scoring.WEIGHTS.items()], "part, w")
_ADJUST = values([(kind, part, 0.0) for kind, (out, _) in S.KINDS.items() for part in out] + [(kind, part, x) for kind, (_, factors) in S.KINDS.items() for part, x in factors.items()], "kind, part, factor")
_WEIGHTS = f"""w AS (SELECT kind, part, x / sum(x) OVER (PARTITION BY kind) AS weight, x = 0 AS excluded FROM (SELECT k.kind, r.part, r.w::DOUBLE * coalesce(a.factor, 1)::DOUBLE AS x
    FROM (SELECT unnest([{', '.join(repr(k) for k in S.KINDS)}]) AS kind) k CROSS JOIN (SELECT * FROM {_RAW}) r LEFT JOIN (SELECT * FROM {_ADJUST}) a ON a.kind = k.kind AND a.part = r.part))"""


@query("score_weights", f"WITH {_WEIGHTS} SELECT kind, part, floor(weight * 1000000 + 0.5) / 1000000 AS weight FROM w")
def score_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights that apply to each kind of file: some sub-scores left out, some raised or lowered, scaled to 1."""
    rows = [(kind, part, w) for kind, ws in S.kind_weights().items() for part, w in ws.items()]
    return spark.createDataFrame(rows, "kind string, part string, weight double").select("kind", "part", (F.floor(F.col("weight") * 1000000 + 0.5) / 1000000).alias("weight"))


_TOTAL = f"""m AS (SELECT name, part, score FROM {_MELT}), q AS (SELECT p.name, p.kind, m.part, CASE WHEN w.excluded THEN 0 ELSE m.score END AS score, w.weight FROM p JOIN m USING (name) JOIN w ON w.kind = p.kind AND w.part = m.part),
    b AS (SELECT name, sum(score * weight) AS base, map_from_entries(list((part, score))) AS s FROM q GROUP BY name)"""
_FACTOR = (
    ("in_cycle", "s['circular'] > 0", 2.0), ("unhandled", "s['error_handling'] > 70", 1.8), ("any_type", "s['types'] > 60", 1.2), ("seo_missing", "kind = 'page' AND s['seo'] > 60", 1.1),
    ("accessibility_missing", "s['accessibility'] > 50", 1.2), ("handled", "s['error_handling'] < 20 AND handling + boundaries > 0", 0.8), ("typed", "s['types'] < 20 AND NOT untyped_props AND props > 0", 0.85),
    ("simple", "s['cyclomatic'] < 30 AND s['maintainability'] < 20", 0.85),
    ("good_seo", "kind = 'page' AND s['seo'] < 20 AND has_meta AND title_length BETWEEN 30 AND 60 AND description_length BETWEEN 120 AND 160 AND has_open_graph", 0.95),
    ("good_accessibility", "s['accessibility'] < 15 AND (images = 0 OR (images - missing_alt) / images >= 0.8) AND aria_misuse = 0", 0.92),
)
_PRODUCT = " * ".join(f"CASE WHEN {c} THEN {x}::DOUBLE ELSE 1.0::DOUBLE END" for _, c, x in _FACTOR)
_NAMES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in _FACTOR) + "], lambda x: x IS NOT NULL), ',')"


@query(
    "component_scores",
    f"""WITH {_FACTS}, {_PARTS}, {_WEIGHTS}, {_TOTAL} SELECT name, kind, floor(base * 10000 + 0.5) / 10000 AS base, {_NAMES} AS factors, floor(least(100.0::DOUBLE, base * {_PRODUCT}) * 100 + 0.5) / 100 AS score FROM p JOIN b USING (name)""",
)
def component_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From facts to final scores: sub-scores, weights by kind of file, multipliers."""
    return S.scored(_facts(spark)).select("name", "kind", (F.floor(F.col("base") * 10000 + 0.5) / 10000).alias("base"), F.array_join("factors", ",").alias("factors"), "score")


@query(
    "score_breakdown",
    f"WITH {_FACTS}, {_PARTS}, {_WEIGHTS}, {_TOTAL} SELECT q.name, q.part, q.score AS sub_score, floor(q.score * q.weight * 100 + 0.5) / 100 AS contribution, floor(100 * (q.score * q.weight / b.base) * 100 + 0.5) / 100 AS share FROM q JOIN b USING (name) WHERE q.score * q.weight > 0",
)
def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.breakdown(S.scored(_facts(spark))).drop("path")


@query("score_summaries")
def score_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summary(S.scored(_facts(spark)))


_TABLES = {
    "complexity": ([("a.tsx", "A", 9.0, 4.0), ("b.tsx", "B", 2.0, 1.0)], "path string, name string, cyclomatic double, cognitive double"),
    "cycles": ([("a.tsx", 2)], "path string, cycle_size int"),
    "magic": ([("b.tsx", 5)], "path string, magic_numbers int"),
}


@query(
    "joined_facts",
    f"""SELECT c.path, c.name, coalesce(x.cyclomatic, 0)::DOUBLE AS cyclomatic, coalesce(y.cycle_size, 0)::INT AS cycle_size, coalesce(z.magic_numbers, 0)::INT AS magic_numbers, 1.0::DOUBLE AS comment_ratio
    FROM {values([("a.tsx", "A"), ("b.tsx", "B"), ("b.tsx", "C")], "path, name")[:-len(" t(path, name)")]} c(path, name) LEFT JOIN {values(_TABLES["complexity"][0], "path, name, cyclomatic, cognitive").removesuffix(" t(path, name, cyclomatic, cognitive)")} x(path, name, cyclomatic, cognitive) ON x.path = c.path AND x.name = c.name
    LEFT JOIN {values(_TABLES["cycles"][0], "p, n").removesuffix(" t(p, n)")} y(path, cycle_size) ON y.path = c.path LEFT JOIN {values(_TABLES["magic"][0], "p, n").removesuffix(" t(p, n)")} z(path, magic_numbers) ON z.path = c.path""",
)
def joined_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of facts for each component, left joined from the analyses' tables."""
    own = spark.createDataFrame([("a.tsx", "A"), ("b.tsx", "B"), ("b.tsx", "C")], "path string, name string")
    found = {k: spark.createDataFrame(rows, schema) for k, (rows, schema) in _TABLES.items()}
    return S.component_facts(own, found).select("path", "name", "cyclomatic", "cycle_size", "magic_numbers", "comment_ratio")
