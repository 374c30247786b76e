"""The eighteen sub-scores of a component, weights by kind of file, multipliers, and the final score.

All functions are Columns over one row of facts a component; ``component_facts`` joins that row from the analyses' own tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import round_half_up
from quarry.operators import scoring

#: From which value on a measure counts as high (fixed values).
HIGH = {
    "cyclomatic": 8, "cognitive": 12, "maintainability": 50, "coupling": 0.85, "ratio": 0.1, "magic": 15, "any": 1, "complex_types": 2,
    "conditionals": 4, "nesting": 3, "alt": 3, "lazy": 3, "missing": 15, "similarity": 0.8,
}
#: By kind of file: sub-scores that don't apply, and factors on weights (fixed values).
KINDS: dict[str, tuple[tuple[str, ...], dict[str, float]]] = {
    "constants": (("magic_numbers", "code_metrics", "duplication", "flow", "seo", "accessibility"), {"types": 0.3, "translation": 0.1}),
    "config": (("magic_numbers", "flow", "translation", "seo", "accessibility"), {"types": 0.5, "code_metrics": 0.3}),
    "types": (("flow", "seo", "accessibility", "performance", "error_handling"), {"types": 2.5}),
    "utility": ((), {"seo": 0.1, "accessibility": 0.1, "error_handling": 1.5, "types": 1.4, "cyclomatic": 1.2}),
    "component": ((), {"seo": 0.3, "cyclomatic": 1.3, "cognitive": 1.3, "coupling": 1.2, "flow": 1.4}),
    "hook": ((), {"coupling": 0.7, "seo": 0.1, "accessibility": 0.1, "error_handling": 1.4, "types": 1.3, "cyclomatic": 1.2}),
    "page": ((), {"seo": 0.2, "accessibility": 0.4, "translation": 0.8, "cyclomatic": 1.8, "cognitive": 1.8, "coupling": 1.5, "flow": 1.6, "error_handling": 1.3}),
}
#: Factors on the final score (fixed values).
FACTORS = {
    "in_cycle": 2.0, "unhandled": 1.8, "any_type": 1.2, "seo_missing": 1.1, "accessibility_missing": 1.2,
    "handled": 0.8, "typed": 0.85, "simple": 0.85, "good_seo": 0.95, "good_accessibility": 0.92,
}
#: What the sub-scores are computed from, with the value that stands for "nothing found". Counts are of the component alone, but for
#: those marked "project", which the reference's rules take from the whole project.
FACTS: dict[str, tuple[str, object]] = {
    "name": ("string", ""), "path": ("string", ""), "content": ("string", None),
    "cyclomatic": ("double", 0.0), "cognitive": ("double", 0.0), "maintainability": ("double", None), "coupling": ("double", 0.0),
    "cycle_size": ("int", 0), "cycle_critical": ("boolean", False), "zombie_size": ("int", 0), "zombie_risk": ("string", ""),
    "risky": ("int", 0), "risky_handled": ("int", 0), "risky_severe": ("int", 0), "unhandled_points": ("double", 0.0), "fallbacks": ("int", 0), "boundaries": ("int", 0), "handling": ("int", 0),
    "untyped_props": ("boolean", False), "any_uses": ("int", 0), "complex_types": ("int", 0), "untyped_returns": ("int", 0), "interfaces": ("int", 0), "props": ("int", 0),
    "images": ("int", 0), "missing_alt": ("int", 0), "aria_misuse": ("int", 0), "inputs": ("int", 0), "unlabelled": ("int", 0), "mains": ("int", 0), "headers": ("int", 0), "navs": ("int", 0),
    "not_lazy": ("int", 0), "images_not_lazy": ("int", 0), "heavy_imports": ("int", 0), "vitals": ("int", 0),
    "has_meta": ("boolean", False), "title_length": ("int", 0), "description_length": ("int", 0), "has_open_graph": ("boolean", False), "heading_issues": ("int", 0),
    "missing_keys": ("int", 0), "duplicate_values": ("int", 0), "magic_numbers": ("int", 0), "comment_ratio": ("double", 1.0), "similarity": ("double", 0.0),
    "in_flow": ("boolean", False), "conditionals": ("int", 0), "flow_depth": ("int", 0),
}


def file_kind(name: Column, path: Column) -> Column:
    """constants, config, types, page, hook, utility or component, tried in this order."""
    n, p = F.lower(name), F.lower(path)
    has = lambda c, *words: reduce(lambda a, w: a | c.contains(w), words, F.lit(False))
    return (
        F.when(has(n, "constant", "config") | has(p, "/constants/", "/config/"), "constants")
        .when(has(n, ".config", "configuration") | has(p, "config.") | n.endswith("rc"), "config")
        .when(has(n, ".types", ".type", "interface", "schema") | has(p, "/types/"), "types")
        .when(has(p, "/pages/") | (has(p, "/app/") & has(p, "page.")), "page")
        .when(n.startswith("use") & (F.length(n) > 3), "hook")
        .when(has(p, "/utils/", "/helpers/", "/lib/") | has(n, "util"), "utility")
        .otherwise("component")
    )


def _least(x: Column, most: float) -> Column:
    return F.least(x, F.lit(float(most)))


def _over(count: Column, free: int, each: float) -> Column:
    """Points for what a count exceeds a free number by."""
    return F.when(count > free, (count - free) * each).otherwise(0.0)


def _count(pattern: str) -> Column:
    return F.regexp_count("content", F.lit(pattern))


def _lines() -> Column:
    return F.size(F.split("content", "\n", -1))


def sub_scores() -> dict[str, Column]:
    """Each sub-score, 0 to 100, over the columns of FACTS; a higher score is a larger problem."""
    c = F.col
    when = lambda condition, points: F.when(condition, float(points)).otherwise(0.0)
    whole = lambda x: _least(round_half_up(x), 100)
    severe = F.when(c("cycle_critical"), 1.0).otherwise(0.8)
    circular = F.when(c("cycle_size") > 0, round_half_up(100 * severe * _least(c("cycle_size") / 5, 1))).otherwise(0.0)
    errors = c("unhandled_points") + when((c("fallbacks") > 0) & (c("boundaries") == 0), 40) + when((c("risky_severe") > 0) & (c("risky_handled") == 0), 50)
    errors = errors + F.when(c("risky") > 0, (c("risky") - c("risky_handled")) / c("risky") * 60).otherwise(0.0)
    complexity = round_half_up(_least(c("cyclomatic") / HIGH["cyclomatic"] * 50, 50) + _least(c("cognitive") / HIGH["cognitive"] * 50, 50))
    low = float(HIGH["maintainability"])
    maintainability = F.when(c("maintainability") < low, round_half_up((low - c("maintainability")) / low * 100)).otherwise(0.0)
    coupling = round_half_up(_least(c("coupling") / HIGH["coupling"] * 100, 100))
    types = when(c("untyped_props"), 50) + F.when(c("any_uses") > HIGH["any"], _least(c("any_uses") * 15.0, 40)).otherwise(0.0)
    types = types + when(c("complex_types") > HIGH["complex_types"], 25) + _least(c("untyped_returns") * 10.0, 30)
    types = round_half_up(F.when((c("interfaces") > 0) & ~c("untyped_props"), F.greatest(types - 15, F.lit(0.0))).otherwise(types))
    share = F.coalesce(F.try_divide(c("unlabelled").cast("double"), c("inputs").cast("double")), F.lit(0.0))
    framed = c("path").contains("/pages/") | c("path").contains("layout")
    accessibility = _least(c("missing_alt") / HIGH["alt"] * 40, 40) + _least(c("aria_misuse") * 10.0, 30) + F.when(share > 0.1, share * 50).otherwise(0.0)
    accessibility = accessibility + when(framed & (c("mains") == 0), 20) + when(framed & (c("headers") == 0), 15) + when(framed & (c("navs") == 0), 10)
    performance = c("not_lazy") * 25.0 + F.when(c("images_not_lazy") > HIGH["lazy"], _least(c("images_not_lazy") * 10.0, 30)).otherwise(0.0)
    performance = performance + _least(c("heavy_imports") * 20.0, 40) + c("vitals") * 15.0
    page = c("path").contains("/pages/") | c("path").contains("/app/") | c("path").contains("page.") | F.lower("name").contains("page")
    plain = page & F.coalesce(c("content").contains("generateMetadata") & (_lines() < 50), F.lit(False))
    title, description = c("title_length"), c("description_length")
    meta = when(title == 0, 30) + when(description == 0, 30) + when((title > 0) & ~title.between(20, 70), 10) + when((description > 0) & ~description.between(100, 180), 10) + when(~c("has_open_graph"), 15)
    seo = F.when(plain, 0.0).otherwise(F.when(page & c("has_meta"), meta).otherwise(0.0) + c("heading_issues") * 8.0)
    danger = F.when(c("zombie_risk") == "high", 1.0).when(c("zombie_risk") == "medium", 0.7).otherwise(0.4)
    zombie = F.when(c("zombie_size") > 0, round_half_up(100 * danger * _least(c("zombie_size") / 10, 1))).otherwise(0.0)
    missing = F.when(c("missing_keys") > HIGH["missing"], 60.0).otherwise(c("missing_keys") / HIGH["missing"] * 60)
    renders = F.when(c("conditionals") > HIGH["conditionals"], 40.0).otherwise(c("conditionals") / HIGH["conditionals"] * 40)
    flow = F.when(c("in_flow"), renders + when(c("flow_depth") > HIGH["nesting"], 30)).otherwise(0.0)
    return {
        "circular": circular, "error_handling": whole(errors), "cyclomatic": complexity, "cognitive": F.lit(0.0), "maintainability": maintainability, "types": types,
        "accessibility": whole(accessibility), "performance": whole(performance), "seo": whole(seo), "coupling": coupling, "zombie": zombie,
        "translation": whole(missing + c("duplicate_values") * 5.0), "flow": whole(flow),
        "duplication": F.when(c("similarity") > HIGH["similarity"], round_half_up(c("similarity") * 100)).otherwise(0.0),
        "code_metrics": when(c("comment_ratio") < HIGH["ratio"], 30), "magic_numbers": round_half_up(_least(c("magic_numbers") / HIGH["magic"] * 100, 100)),
        "react": F.coalesce(whole(_react()), F.lit(0.0)), "container": F.coalesce(whole(_container()), F.lit(0.0)),
    }


def _react() -> Column:
    """What the text shows of hooks, choices, nested braces, length, waiting and stores; null without a text."""
    nested = _count(r"\{\s*[^}]*\{[^}]*\}[^}]*\}")
    waits = ((_count(r"async\s+") > 2) | (_count(r"await\s+") > 3)) & (_count(r"try\s*\{") == 0)
    return (
        _over(_count(r"useEffect\s*\("), 3, 15.0) + _over(_count(r"useState\s*[<(]"), 5, 8.0) + _over(_count(r"\?\s*[^:]*:"), 3, 10.0) + F.when(nested > 2, nested * 8.0).otherwise(0.0)
        + _over(_lines(), 150, 0.3) + F.when(waits, 25.0).otherwise(0.0) + _over(_count(r"use\w*Store\s*\("), 3, 12.0)
    )


#: Work that a container should leave to others (fixed values).
_WORK = (r"useEffect\s*\(", r"useState\s*[<(]", r"async\s+", r"setInterval\s*\(", r"setTimeout\s*\(", r"fetch\s*\(", r"axios\.")


def _container() -> Column:
    points = sum((F.when(_count(p) > 2, _count(p) * 8.0).otherwise(0.0) for p in _WORK), F.lit(0.0)) + _over(_count(r"<\w"), 10, 2.0)
    return F.when(F.col("name").rlike("(Container|Provider|Wrapper|Manager|Controller)$") | F.col("path").contains("container"), points).otherwise(F.lit(0.0))


def kind_weights(weights: dict[str, float] | None = None) -> dict[str, dict[str, float]]:
    """For each kind of file the weights that apply, summing to 1."""
    out = {}
    for kind, (left_out, factors) in KINDS.items():
        own = {k: 0.0 if k in left_out else w * factors.get(k, 1.0) for k, w in (weights or scoring.WEIGHTS).items()}
        total = sum(own.values())
        out[kind] = {k: w / total for k, w in own.items()} if total > 0 else own
    return out


def scored(facts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """All facts, each sub-score as s_<name>, kind, base (the weighted sum) and score (after multipliers, 2 digits)."""
    table = kind_weights(weights)
    known = facts.withColumns({f"s_{k}": s for k, s in sub_scores().items()}).withColumn("kind", file_kind(F.col("name"), F.col("path")))
    base = F.lit(0.0)
    for part in next(iter(table.values())):
        by_kind = reduce(lambda c, kind: c.when(F.col("kind") == kind, F.lit(table[kind][part])), table, F)  # noqa: B023
        excluded = F.col("kind").isin([k for k, (left_out, _) in KINDS.items() if part in left_out]) if any(part in x for x, _ in KINDS.values()) else F.lit(False)
        known = known.withColumn(f"s_{part}", F.when(excluded, 0.0).otherwise(F.col(f"s_{part}")))
        base = base + F.col(f"s_{part}") * by_kind
    s = lambda part: F.col(f"s_{part}")
    c, page = F.col, F.col("kind") == "page"
    good_seo = c("has_meta") & c("title_length").between(30, 60) & c("description_length").between(120, 160) & c("has_open_graph")
    good_alt = F.coalesce(F.try_divide((c("images") - c("missing_alt")).cast("double"), c("images").cast("double")), F.lit(1.0)) >= 0.8
    conditions = {
        "in_cycle": s("circular") > 0, "unhandled": s("error_handling") > 70, "any_type": s("types") > 60, "seo_missing": page & (s("seo") > 60), "accessibility_missing": s("accessibility") > 50,
        "handled": (s("error_handling") < 20) & (c("handling") + c("boundaries") > 0), "typed": (s("types") < 20) & ~c("untyped_props") & (c("props") > 0),
        "simple": (s("cyclomatic") < 30) & (s("maintainability") < 20), "good_seo": page & (s("seo") < 20) & good_seo, "good_accessibility": (s("accessibility") < 15) & good_alt & (c("aria_misuse") == 0),
    }
    factors = [(conditions[k], FACTORS[k]) for k in FACTORS]
    applied = F.array_compact(F.array(*(F.when(conditions[k], F.lit(k)) for k in FACTORS)))
    return known.withColumns({"base": base, "factors": applied}).withColumn("score", scoring.multiplied(F.col("base"), factors))


def component_facts(components: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row of facts a component: components (path, name, content, ...) with each of the tables, which are keyed by path, or by path
    and name, and hold some of the columns of FACTS. What no table says about a component has the value for "nothing found"."""
    rows = components
    for found in tables.values():
        keys = [k for k in ("path", "name") if k in found.columns]
        rows = rows.join(found, keys, "left")
    none = [F.coalesce(F.col(c).cast(kind), F.lit(empty).cast(kind)).alias(c) if c in rows.columns else F.lit(empty).cast(kind).alias(c) for c, (kind, empty) in FACTS.items()]
    return rows.select(*none, *(F.col(c) for c in rows.columns if c not in FACTS))


def breakdown(scored_: DataFrame, least: float = 0.0) -> DataFrame:
    """path, name, part, sub_score, contribution, share (of the base, in percent): a row for each sub-score that counts."""
    table = kind_weights()
    parts = F.array(*(F.struct(F.lit(p).alias("part"), F.col(f"s_{p}").alias("sub_score"), (F.col(f"s_{p}") * reduce(lambda c, kind: c.when(F.col("kind") == kind, F.lit(table[kind][p])), table, F)).alias("contribution")) for p in scoring.WEIGHTS))  # noqa: B023
    rows = scored_.select("path", "name", "base", F.explode(parts).alias("x")).where(F.col("x.contribution") > least)
    return rows.select("path", "name", "x.part", "x.sub_score", round_half_up(F.col("x.contribution"), 2).alias("contribution"), round_half_up(100 * F.try_divide(F.col("x.contribution"), F.col("base")), 2).alias("share"))


def summary(scored_: DataFrame) -> DataFrame:
    """path, name, text: one sentence on the score and its largest parts."""
    top = breakdown(scored_).groupBy("path", "name").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("contribution")).alias("less"), "part", "sub_score"))), 1, 3).alias("top"))
    named = F.array_join(F.transform("top", lambda x: F.concat(x.part, F.lit(" "), F.format_number(x.sub_score, 0))), ", ")
    rows = scored_.select("path", "name", "kind", "score").join(top, ["path", "name"], "left")
    most = F.when(F.col("top").isNotNull(), F.concat(F.lit("; most: "), named)).otherwise("")
    return rows.select("path", "name", F.concat(F.col("name"), F.lit(" ("), F.col("kind"), F.lit("): "), scoring.range_of(F.col("score")), F.lit(" "), F.format_number("score", 2), most).alias("text"))
