from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions import text as T
from quarry.plans import rules
from quarry.plans.texts import LINE_CASES


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


def test_line_metrics_cases(spark):
    for name, content, *want in LINE_CASES:
        m = one(spark, T.line_metrics(F.col("c")), c=content)
        assert [m.total, m.code, m.comment, m.blank] == want, name


def test_rounding_goes_up_at_halves(spark):
    assert [one(spark, T.round_half_up(F.col("x")), x=x) for x in (2.5, -2.5, -2.51, 0.49)] == [3, -2, -3, 0]
    assert one(spark, T.round_half_up(F.col("x"), 2), x=1.005001) == 1.01


def test_hash_wraps_to_32_bits(spark):
    def want(s):
        h = 0
        for c in s:
            h = (31 * h + ord(c) + 2**31) % 2**32 - 2**31
        return h

    for s in ("", "a", "interface User { name: string }", "zzzzzzzzzzzz"):
        assert one(spark, T.hash32(F.col("s")), s=s) == want(s)


def test_paths(spark):
    assert one(spark, P.basename(F.col("p")), p="a/b/c.test.ts") == "c.test.ts"
    assert one(spark, P.dirname(F.col("p")), p="a/b/c.ts") == "a/b"
    assert one(spark, P.extension(F.col("p")), p="a/.env") == ""
    assert one(spark, P.stem(F.col("p")), p="a/b.c.ts") == "b.c"
    assert one(spark, P.package_name(F.col("p")), p="@scope/pkg/deep") == "@scope/pkg"
    assert one(spark, P.package_name(F.col("p")), p="lodash/get") == "lodash"
    assert one(spark, P.normal_link(F.col("p")), p="/docs/index?x=1") == "/docs"
    assert one(spark, P.normal_link(F.col("p")), p="/") == "/"
    assert one(spark, P.route_of_file(F.col("p")), p="app/(a)/x/[...y]/page.tsx") == "/x/*"


def test_common_prefix_and_positions(spark):
    assert one(spark, T.common_prefix(F.col("a"), F.col("b")), a="UserProps", b="UserState") == "User"
    at = one(spark, T.line_and_column(F.col("c"), F.col("i")), c="ab\ncd\n", i=4)
    assert (at.line, at.column) == (2, 2)


def test_findings_are_where_they_stand(spark):
    found = rules.findings_with_position(spark, "").where("path in ('src/a.ts', 'src/b.tsx', 'src/c.js')").collect()
    assert {(r.path, r.rule, r.line, r.column) for r in found} == {
        ("src/a.ts", "direct-eval", 3, 1), ("src/a.ts", "http-url", 5, 11), ("src/a.ts", "math-random", 2, 11), ("src/b.tsx", "console-log-password", 6, 1),
        ("src/b.tsx", "inner-html", 4, 3), ("src/b.tsx", "inner-html", 5, 3), ("src/c.js", "document-cookie", 3, 1), ("src/c.js", "local-storage", 4, 1),
        ("src/c.js", "cookie-without-httponly", 3, 1), ("src/c.js", "cookie-without-samesite", 3, 1), ("src/c.js", "cookie-without-secure", 3, 1), ("src/c.js", "nodejs-builtin-import", 1, 12),
        ("src/c.js", "process-env", 5, 11), ("src/c.js", "process-env", 5, 33), ("src/c.js", "settimeout-string", 2, 1),
    }
