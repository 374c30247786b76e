import json

import pytest

from quarry import __main__, api
from quarry.plans import code as P
from quarry.streaming import findings as S


@pytest.fixture
def tree(tmp_path):
    for path, content in [*P.PROJECT, ("lib/bad.ts", "eval(x);\n")]:
        at = tmp_path / "in" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content)
    return tmp_path


def test_analysis_has_every_table(spark, tree):
    tables = api.analyze(spark, str(tree / "in"))
    counts = {name: df.count() for name, df in tables.items()}
    assert counts["components"] == 3 and counts["lines"] == 6 and counts["findings"] == 1 and counts["environment"] == 2
    assert tables["problems"].count() == 6
    assert {r.path: r.critical for r in tables["security"].collect()} == {"lib/bad.ts": 1}


def test_options_are_checked(spark, tree):
    assert api.Options(extensions=("ts",), weights={"x": -1}, top=0).problems() == ["extension 'ts' has no dot", "weight of x is negative", "top must be positive"]
    with pytest.raises(ValueError):
        api.analyze(spark, api.Options(root=str(tree), top=0))
    assert api.analyze(spark, api.Options(root=str(tree / "in"), exclude="^ui/"))["lines"].count() == 4


def test_command_line(spark, tree, capsys):
    assert __main__.main(["validate", str(tree)]) == 0 and __main__.main(["analyze", str(tree / "in"), "--top", "0"]) == 1
    assert __main__.main(["analyze", str(tree / "in"), "--out", str(tree / "out")]) == 0
    (part,) = (tree / "out").glob("part-*")
    assert "lib/bad.ts" in {x["path"] for x in json.loads(part.read_text())["findings"]}


def test_stream_reports_a_finding_once(spark, tree):
    stream = S.finding_stream(S.arriving_files(spark, str(tree / "in/lib")))
    q = stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tree / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.rule, r.line, r.column) for r in spark.table("arrived").collect()] == [("direct-eval", 1, 1)]


def test_sections_are_written_by_partition(spark, tmp_path):
    from quarry.sinks import report

    rows = spark.range(10).repartition(3)
    report.write_sections({"numbers": rows, "none": rows.limit(0)}, str(tmp_path / "out"))
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "out/numbers")).collect()) == list(range(10))
    assert spark.read.schema("value string").text(str(tmp_path / "out/none")).count() == 0
