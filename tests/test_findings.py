"""Findings without SQL, against lists made by hand."""

from quarry.operators import findings
from quarry.plans import detect, dup, failures, headline, rules, scans, shapes


def test_every_rule_has_a_match(spark):
    hit = {r.rule for r in rules.rule_matches(spark, "").collect()}
    assert hit == {r.id for r in findings.RULES}


def test_detectors_over_sources(spark):
    found = {(r.path, r.rule, r.line, r.severity, r.confidence) for r in detect.security_findings(spark, "").collect()}
    assert {("src/Page.tsx", "nodejs-builtin", 1, "high", "high"), ("src/Page.tsx", "sensitive-server-library", 5, "critical", "high"), ("src/Page.tsx", "potentially-server-only", 6, "medium", "medium"), ("src/Page.tsx", "inner-html", 8, "critical", "medium")} <= found
    # A type's import, a file of a server, and a package that is none.
    assert not [x for x in found if x[1].endswith("library") and x[2] in (2, 3, 4)] and not [x for x in found if x[0] == "src/api/route.ts"]


def test_duplicate_components_are_grouped(spark):
    rows = dup.duplicate_components(spark, "").collect()
    names = {}
    for r in rows:
        names.setdefault(r.group, set()).add(r.component.split("#")[1])
    assert sorted(map(sorted, names.values())) == [["NewBadge", "OldBadge"], ["TeamCard", "UserCard"]]


def test_errors_by_file(spark):
    rows = {r.path: r for r in failures.error_rollup(spark, "").collect()}
    panel, guard = rows["src/ui/Panel.tsx"], rows["src/ui/Guard.tsx"]
    assert (panel.boundaries, panel.tries, panel.states, panel.fallbacks) == (1, 3, 2, 4) and panel.significant
    assert (guard.boundaries, guard.tries, guard.states) == (1, 0, 0) and guard.significant


def test_scores_in_words(spark):
    text = {r.name: r.text for r in headline.score_summaries(spark, "").collect()}
    assert text["Home"].startswith("Home (page): minimal 10.23; most: coupling") and len(text) == len(headline.GIVEN)


def test_scan_patterns_by_kind_of_project(spark):
    globs = [r.glob for r in scans.scan_patterns(spark, "").orderBy("place").collect()]
    assert "pages/api/**/*.{ts,js}" in globs and "app/**/*.{ts,tsx,js,jsx}" not in globs and globs[0] == "next.config.ts"


def test_type_suggestions_say_what_was_found(spark):
    kinds = {(r.kind, r.subject) for r in shapes.type_suggestions(spark, "").collect()}
    assert {("duplicate", "Kind, Sort"), ("complex", "src/h.ts#Deep"), ("any", "src/types.ts")} <= kinds
