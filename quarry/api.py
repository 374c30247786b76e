"""The whole analysis of a project: one call, tables by name, and one nested report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import line_metrics
from quarry.operators import code, errors, findings, graph, locales, modules, scoring, security
from quarry.sinks import report as sink
from quarry.sources import projects, scans, syntax


@dataclass(frozen=True)
class Options:
    """What a caller can change. Rules may be added to or replaced, weights and thresholds overridden."""

    root: str = "."
    extensions: tuple[str, ...] = projects.SOURCE_EXTENSIONS
    exclude: str = ""
    rules: tuple[findings.Rule, ...] = findings.RULES
    weights: dict[str, float] = field(default_factory=lambda: dict(scoring.WEIGHTS))
    excluded_scores: tuple[str, ...] = ()
    top: int = 20

    def problems(self) -> list[str]:
        """What is wrong with the options; empty if nothing."""
        out = [f"extension {e!r} has no dot" for e in self.extensions if not e.startswith(".")]
        out += [f"weight of {k} is negative" for k, w in self.weights.items() if w < 0]
        out += ["top must be positive"] if self.top < 1 else []
        return out


def analyze(spark: SparkSession, options: Options | str) -> dict[str, DataFrame]:
    """Lazy tables by name; nothing is read until one is asked for."""
    if isinstance(options, str):
        options = Options(root=options)
    if bad := options.problems():
        raise ValueError("; ".join(bad))
    every = projects.files(spark, options.root)
    own = projects.sources(every).where(F.col("ext").isin(*options.extensions))
    if options.exclude:
        own = own.where(~F.col("path").rlike(options.exclude))
    nodes = syntax.nodes(own)
    parts = code.elements(nodes)
    found = security.detect(own, nodes, options.rules)
    measured = code.complexity(nodes)
    lines = own.select("path", line_metrics(F.col("content")).alias("m")).select("path", "m.*")
    linked = modules.project_edges(nodes, every)
    named = linked.where("not external")
    edges = graph.dependency_graph(named.select(modules.component_id(F.col("src_path"), F.col("src")).alias("src"), modules.component_id(F.col("dst_path"), F.col("dst")).alias("dst")))
    return {
        "lines": lines, "packages": projects.packages(every), "project": projects.project_type(projects.packages(every)), "environment": projects.environment(every),
        "api_routes": scans.api_routes(every), "middleware": scans.middleware(every), "flags": scans.flags(own), "functions": code.functions(nodes), "complexity": measured, "halstead": code.halstead(nodes),
        "component_edges": linked, "imports": modules.resolved(code.imports(nodes), every), "exports": code.exports(nodes), "components": code.components(nodes), "edges": edges, "degrees": graph.degrees(edges), "findings": found,
        "security": findings.severity_counts(found, "path"), "accessibility": code.accessibility_violations(parts), "duplicate_ids": code.duplicate_ids(parts), "headings": code.heading_skips(parts),
        "types": code.type_definitions(nodes), "duplicate_types": code.duplicate_types(code.type_definitions(nodes)), "magic_numbers": code.magic_numbers(nodes),
        "errors": errors.risks(nodes), "translation_keys": code.translation_keys(nodes), "translations": locales.entries(locales.files_of(every, locales.FOLDERS + locales.NAMESPACED_FOLDERS)),
        "problems": problem_scores(measured, found, options),
    }


def problem_scores(measured: DataFrame, found: DataFrame, options: Options) -> DataFrame:
    """path, score, range: the files with the highest scores, from complexity and findings."""
    per = measured.groupBy("path").agg(F.max("cyclomatic").alias("cyclomatic"), F.max("cognitive").alias("cognitive"))
    bad = found.groupBy("path").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count(F.lit(1)).alias("n"))
    rows = per.join(bad, "path", "left").fillna(0, ["critical", "n"])
    hundred = lambda c: F.least(F.lit(100.0), c.cast("double"))
    parts = {"cyclomatic": hundred(F.col("cyclomatic") * 5), "cognitive": hundred(F.col("cognitive") * 4), "error_handling": hundred(F.col("n") * 10), "code_metrics": hundred(F.col("critical") * 40)}
    score = scoring.multiplied(scoring.weighted(parts, options.weights, options.excluded_scores), [(F.col("critical") > 0, 1.2)])
    ranked = rows.select("path", score.alias("score"))
    return ranked.withColumn("range", scoring.range_of(F.col("score"))).orderBy(F.desc("score"), "path").limit(options.top)


def report(spark: SparkSession, options: Options | str, sections: tuple[str, ...] = ("project", "lines", "components", "findings", "errors", "accessibility", "problems")) -> DataFrame:
    tables = analyze(spark, options)
    return sink.report(spark, {name: tables[name] for name in sections})
