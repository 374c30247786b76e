"""Trees of pages against a stack machine over the standard library's parser, and what is asked of trees against plain loops."""

import itertools
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quarry.operators import markup as K
from quarry.plans import markup as P
from quarry.sources import markup as M
from quarry.sources import pages as H

SF = "/root/testdata/sf0.001"


class Stack(HTMLParser):
    """Elements as (tag, depth, tag of the parent, text inside) in order of their start tags."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.found = [], []

    def close(self):
        super().close()
        self.open.clear()

    def begin(self, tag, pushes):
        for tags, ends, beyond in M.IMPLIED:
            if tag in tags:
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i]["tag"] in ends:
                        del self.open[i:]
                        break
                    if self.open[i]["tag"] in beyond:
                        break
                break
        e = {"tag": tag, "depth": len(self.open), "parent": self.open[-1]["tag"] if self.open else None, "text": ""}
        self.found.append(e)
        if pushes:
            self.open.append(e)

    def handle_starttag(self, tag, attrs):
        self.begin(tag, tag not in M.VOID)

    def handle_startendtag(self, tag, attrs):
        self.begin(tag, False)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if not (self.open and self.open[-1]["tag"] in M.RAW):
            for e in self.open:
                e["text"] += data

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def parsed(html):
    s = Stack()
    s.feed(html or "")
    s.close()
    return [(e["tag"], e["depth"], e["parent"], " ".join(e["text"].split())) for e in s.found]


def built(spark, pages):
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id int, url string, html string")
    trees = M.trees(df)
    every = {t for tags, _, _ in M.IMPLIED for t in tags} | {*M.VOID, *M.RAW, "a", "b", "i", "html", "head", "body", "button", "label", "span", "select", "tfoot"}
    rows = M.elements(trees, texts=tuple(every)).orderBy("page_id", "node_id").collect()
    out = [[] for _ in pages]
    for page, group in itertools.groupby(rows, lambda r: r.page_id):
        nodes = {r.node_id: r for r in group}
        for r in nodes.values():
            above = nodes.get(r.parent_id)
            assert (r.parent_id == -1 and r.depth == 0) or (above.node_id < r.node_id <= r.exit <= above.exit and above.depth == r.depth - 1)
            if r.tag != "#text":
                out[page].append((r.tag, r.depth, above.tag if above else None, r.text))
    return out


def test_trees_are_those_of_a_stack(spark):
    rng = random.Random(7)
    tags = ["p", "li", "ul", "ol", "b", "a", "div", "td", "tr", "table", "dt", "dd", "dl", "option", "select", "h1", "h2", "button", "span", "tbody"]

    def page():
        parts = []
        for _ in range(rng.randint(0, 40)):
            t = rng.choice(tags)
            parts.append(rng.choice([f"<{t}>", f"<{t}>", f"</{t}>", f'<{t} class="a>b" id=\'x\'>', f"<{t.upper()}>", "word ", "<br>", "<br/>", '<img src="a">', "<!-- <p> -->", "&amp;", f"<{t}/>", "\n"]))
        return "".join(parts)

    pages = [page() for _ in range(300)]
    # The library gives what follows an unfinished tag at the end as text; tags are whole here.
    for html, got in zip(pages, built(spark, pages), strict=True):
        assert got == parsed(html), html


def test_long_pages_cross_blocks(spark):
    html = "<ul>" + "<li>one <b>two</b>" * 500 + "</ul>" + "<div>" * 60 + "x" + "</div>" * 30 + "<p>end"
    (got,) = built(spark, [html])
    assert got == parsed(html) and len(got) > 4 * M.BLOCK


def test_given_pages(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    no_raw = lambda rows: [r[:3] for r in rows]
    for html, got in zip(pages, built(spark, pages), strict=True):
        assert no_raw(got) == no_raw(parsed(html))


def test_cases(spark):
    assert built(spark, [None, "", "  ", "text", "</p>", "<", "a < b", "<script>x", "<p"]) == [[], [], [], [], [], [], [], [("script", 0, None, "x")], []]
    (raw,) = built(spark, ["<title>a <b></title><script>if (a < b) '</p>'</script><textarea><p></textarea><p>x"])
    assert [r[0] for r in raw] == ["title", "script", "textarea", "p"]


def test_links_with_inner_tags_and_any_quotes(spark):
    html = "<a href=\"/x\"><b>go</b> on</a><a class='l' href='/y'>y</a><a href=/z>z</a><!-- <a href=\"/n\">n</a> --><script>\"<a href='/s'>s</a>\"</script><a name=q>q</a><abbr href='/w'>w</abbr><a\n href=\"/v>w\"></a>"
    df = spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
    want = [("/x", "go on"), ("/y", "y"), ("/z", "z"), ("/v>w", "")]
    assert [(r.href, r.label) for r in H.links(df).orderBy("seq").collect()] == want
    tree = M.elements(M.trees(df), only=lambda x: x["tag"] == "a", texts=("a",)).select("node_id", M.attribute(F.col("token"), "href").alias("href"), "text").where("href is not null")
    assert [(r.href, r.text) for r in tree.orderBy("node_id").collect()] == want


def test_both_ways_to_links_agree(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    tree = M.elements(M.trees(pages), only=lambda x: x["tag"] == "a", texts=("a",)).select("page_id", M.attribute(F.col("token"), "href").alias("href"), "text").where("href is not null")
    assert sorted(map(tuple, H.links(pages).select("page_id", "href", "label").collect())) == sorted(map(tuple, tree.collect()))


def test_containment_is_that_of_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), i, i + rng.choice([0, 1, 5, 40, 400])) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id int, node_id int, exit int")
    want = {(p, a, b) for p, a, e in rows for q, b, _ in rows if p == q and a < b <= e}
    assert {tuple(r) for r in K.contained(df, df, width=16).collect()} == want


@pytest.fixture(scope="module")
def shapes(spark):
    rng = random.Random(4)

    def part(n):
        return "".join(f"<div>{part(n - 1)}</div>" if n and rng.random() < 0.5 else rng.choice(["<b></b>", "<i></i>", "<p><b></b></p>"]) for _ in range(rng.randint(0, 3)))

    pages = [f"<body>{part(3)}</body>" for _ in range(30)]
    return M.trees(spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages + pages[:5])], "page_id int, url string, html string")).cache()


def test_repeated_subtrees(shapes):
    nodes = {}
    for r in M.elements(shapes).collect():
        nodes.setdefault(r.page_id, []).append(r)
    every = []
    for page, rows in nodes.items():
        rows.sort(key=lambda r: r.node_id)
        shape = {r.node_id: tuple((x.tag, x.depth - r.depth) for x in rows if r.node_id <= x.node_id <= r.exit) for r in rows}
        every += [(shape[r.node_id], page, r.node_id, shape.get(r.parent_id)) for r in rows]
    count = {}
    for s, *_ in every:
        count[s] = count.get(s, 0) + 1
    want = set()
    for s in {s for s, *_ in every if len(s) >= 3 and count[s] > 1}:
        above = [a for t, _, _, a in every if t == s]
        if len(set(above)) == 1 and above[0] is not None and count[above[0]] == count[s] > 1:
            continue
        at = min((p, n) for t, p, n, _ in every if t == s)
        want.add((len(s), count[s], len({p for t, p, _, _ in every if t == s}), *at))
    got = K.repeated_subtrees(K.subtrees(shapes)).select("size", "copies", "pages", "first_page", "first_node").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_alike_bags(shapes, percent):
    bags = {}
    for r in M.elements(shapes).collect():
        bags.setdefault(r.page_id, {}).setdefault((r.tag, r.depth), 0)
        bags[r.page_id][r.tag, r.depth] += 1
    first = {}
    for p in sorted(bags):
        first.setdefault(frozenset(bags[p].items()), p)
    pairs, member = K.alike_bags(K.bags(shapes), percent)
    assert {tuple(r) for r in member.collect()} == {(p, first[frozenset(b.items())]) for p, b in bags.items()}
    want = set()
    for a, b in itertools.combinations(sorted(first.values()), 2):
        keys = bags[a].keys() | bags[b].keys()
        low, high = (sum(f(bags[a].get(k, 0), bags[b].get(k, 0)) for k in keys) for f in (min, max))
        if 100 * low >= percent * high:
            want.add((a, b, low, high))
    assert {tuple(r) for r in pairs.collect()} == want


def test_no_python_worker_and_one_pass_for_summaries(spark):
    trees = M.trees(P._pages(spark, SF))
    for df in (P.page_nodes(spark, SF), K.bags(trees), K.subtrees(trees), *(q(spark, SF) for q in (P.page_findings, P.finding_summaries, P.repeated_subtrees, P.page_templates, P.landmark_contents))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "MapInArrow" not in plan and "Cartesian" not in plan
    assert P.finding_summaries(spark, SF)._jdf.queryExecution().executedPlan().toString().count("Expand") == 1
