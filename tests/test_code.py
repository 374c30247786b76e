import json

from quarry.operators import errors, locales, modules
from quarry.plans import code as P
from quarry.sources import projects as J
from quarry.sources import scans, syntax


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def kinds(source, path="a.tsx"):
    return [(r[7], r[8]) for r in syntax.parse(path, source)]


def test_parser_tells_values_from_types_and_markup():
    assert ("Regex", None) in kinds("x = a / b; y = /re[/]x/g;") and kinds("x = a / b / c").count(("Operator", "/")) == 2
    assert ("JsxElement", "b") in kinds("const x = <b>hi</b>") and ("JsxElement", "T") not in kinds("const f = <T,>(x: T) => x")
    assert ("Call", "foo") in kinds("foo<Bar>(1)") and ("Operator", "<") in kinds("if (a < b) {}")
    assert ("EnumMember", "A") in kinds("const enum E { A }") and ("Function", "get") not in kinds("class A { get x() { return 1 } }")
    assert kinds("const s = `a ${b ? `${c}` : 'd'} e`; f()")[-1] == ("Call", "f")
    assert ("Conditional", None) not in kinds("function f(a?: string, b?: number): a is string { return a?.b ?? c }")


def test_arrows_with_types_are_functions():
    for source in ("const f = (a: A, b: any[]): Promise<U> => { g(); }", "const f = <T,>(x: T): T[] => [x]", "const f = (): { a: string } => ({ a: 1 })", "const f = (x: (a: number) => string): x is B => x"):
        assert [n for k, n in kinds(source) if k == "Function"] == ["f"], source
    assert ("ReturnType", "Promise<U>") in kinds("const f = (a: A): Promise<U> => a")


def test_broken_files_still_give_rows():
    for source in ("", "function (", "<div", "`${", "class {", "a = {", "import", "const {a, b", "<a b={", "}}}}", "((((", None):
        assert syntax.parse("x.tsx", source)[0][7] == "Program"


def test_ranges_nest():
    r = syntax.parse("a.tsx", dict(P.PROJECT)["ui/Card.tsx"])
    for x in r:
        if x[2] is not None:
            parent = r[x[2]]
            assert parent[1] < x[1] <= x[3] <= parent[3] and x[4] == parent[4] + 1


def test_functions_and_complexity(spark):
    facts = {(r.path, r.name): r for r in P.function_facts(spark, "").collect()}
    load = facts["lib/data.ts", "load"]
    assert load.is_async and load.return_type == "Promise<string>" and [tuple(p) for p in load.params] == [("id", "number")]
    assert facts["lib/data.ts", "safe"].flavour == "async arrow" and facts["ui/Card.tsx", "onClick"].line == 5
    measured = {(r.path, r.name): (r.cyclomatic, r.cognitive) for r in P.function_complexity(spark, "").collect()}
    # Card: if, &&, for, if, ?: and the choice in markup; loads 1, 2, 2, 3, 1 and 1.
    assert measured["ui/Card.tsx", "Card"] == (7, 10)
    assert measured["lib/data.ts", "safe"] == (2, 1)


def test_imports_exports_components(spark):
    assert rows(P.source_imports(spark, ""), "path", "specifier") == [("app/api/users/route.ts", "zod"), ("app/page.tsx", "../ui/Card"), ("app/page.tsx", "next-intl"), ("ui/Card.tsx", "./Item")]
    assert ("ui/Card.tsx", "Card", True) in rows(P.source_exports(spark, ""), "path", "name", "is_default")
    assert rows(P.react_components(spark, ""), "name") == [("Card",), ("Item",), ("Page",)]
    edges = modules.project_edges(P.nodes(spark), P.project(spark))
    assert rows(edges, "src", "dst_path", "dst") == [("Card", "ui/Item.tsx", "Item"), ("Page", "ui/Card.tsx", "Card")]
    routes = spark.createDataFrame([("/", "app/page.tsx", "Page")], "route string, path string, name string")
    assert rows(modules.flow(routes, edges), "name", "depth") == [("Card", 1), ("Item", 2), ("Page", 0)]


def test_findings(spark):
    found = rows(P.accessibility_findings(spark, ""), "path", "rule")
    assert found == [("app/page.tsx", "img-alt"), ("ui/Card.tsx", "interactive-role"), ("ui/Card.tsx", "link-text-descriptive"), ("ui/Item.tsx", "aria-role-valid")]
    assert rows(P.magic_numbers(spark, ""), "path", "text") == [("lib/data.ts", "42"), ("ui/Card.tsx", "3"), ("ui/Card.tsx", "7")]
    assert rows(P.type_shapes(spark, ""), "n", "names") == [(2, ["CardProps", "Props"])]
    risk = {r.name: r for r in errors.risks(P.nodes(spark)).collect()}
    assert risk["load"].risk == 5 and risk["load"].indicators == ["async", "network", "parsing"] and risk["load"].should_handle and not risk["load"].handled
    assert risk["safe"].handled


def test_project_files(spark):
    assert rows(P.translation_key_usage(spark, ""), "full_key") == [("home.title",)]
    assert rows(locales.entries(locales.files_of(P.project(spark))), "key", "value") == [("home.deep.a", "b"), ("home.title", "Hi"), ("x", "y")]
    assert rows(P.declared_packages(spark, ""), "name", "dev", "category") == [("jest", True, "testing"), ("lodash", False, "other"), ("next", False, "framework"), ("react", False, "framework")]
    assert rows(P.project_type(spark, ""), "framework", "router") == [("next", "app")]
    (r,) = scans.api_routes(P.project(spark)).collect()
    assert (r.route, r.methods, r.has_validation) == ("/users/route", ["GET", "POST"], True)
    assert rows(J.environment(P.project(spark)), "name", "sensitive") == [("API_KEY", True), ("PORT", False)]


def test_report_is_json(spark):
    out = json.loads(P.project_report(spark, "").first().value)
    assert set(out) == {"components", "exports", "accessibility", "errors"} and len(out["components"]) == 3


def test_files_are_read_from_a_tree(spark, tmp_path):
    for path, content in P.PROJECT:
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content)
    (tmp_path / "node_modules/x").mkdir(parents=True)
    (tmp_path / "node_modules/x/i.js").write_text("x")
    got = J.files(spark, str(tmp_path))
    assert rows(got, "path", "content") == sorted(P.PROJECT)
    assert len(J.sources(got).collect()) == 5


def test_every_match_is_a_finding(spark):
    from quarry.operators import findings

    files = spark.createDataFrame([("a.js", "x = Math.random();\n" * 1200)], "path string, content string")
    lines = sorted(r.line for r in findings.match_rules(files).where("rule = 'math-random'").collect())
    assert lines == list(range(1, 1201))
