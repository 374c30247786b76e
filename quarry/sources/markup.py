"""Trees of HTML pages as nested sets, by expressions that Spark runs inside of one scan.

A page is cut to tokens by one pattern. A fold over the tokens keeps a stack of open elements and tells for each token which elements it
closes: an end tag closes what is open down to its start, some start tags end what they cannot stand in (a ``p`` before a block, an ``li`` before
the next one), void elements and those that close themselves never open. Scripts, styles, titles and text areas are one token with what they hold.
The fold works on blocks of tokens, so that long pages don't copy what they have put out so far again and again.

A node is a token: node_id is its place among the page's tokens, exit the place of the last token inside of it, so a node is inside of another if
its node_id is above the other's and at most its exit. Texts that aren't blank are nodes too (``#text``).

Cases: a null or empty page has no node; end tags of what isn't open are ignored; what is open at the end ends there; a ``<`` that starts
no tag is text; entities stay as written; a raw element without an end tag is an ordinary one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import let, passing

#: Fixed values of HTML: elements without content, elements whose content is no markup.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
RAW = ("script", "style", "textarea", "title")
#: Fixed values of HTML: start tags, the open elements that they end, and the elements beyond which they don't.
BLOCKS = (
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul"
).split()
IMPLIED = (
    (tuple(BLOCKS), ("p",), ("button", "caption", "html", "object", "table", "td", "template", "th")),
    (("li",), ("li",), ("menu", "ol", "ul")),
    (("dd", "dt"), ("dd", "dt"), ("dl",)),
    (("option",), ("option",), ("select",)),
    (("optgroup",), ("optgroup", "option"), ("select",)),
    (("td", "th"), ("td", "th"), ("table", "tr")),
    (("tr",), ("tr",), ("table",)),
    (("tbody", "tfoot", "thead"), ("tbody", "tfoot", "thead"), ("table",)),
)
_RAWS = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in RAW)
TOKEN = rf"""(?is)<!--.*?-->|{_RAWS}|</?[a-z][a-z0-9-]*[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>|<![^>]*>|[^<]+|<"""
TAG = r"^</?([a-zA-Z][a-zA-Z0-9-]*)"
_VALUE = r""""[^"]*"|'[^']*'|[^\s"'>]+"""
#: Tokens of a block of the fold.
BLOCK = 64


def attribute_pattern(name: str) -> str:
    """Matches a start tag with the attribute; its one group is the value with its quotes."""
    return rf"""(?is)^<[a-z][^\s/>]*(?:\s+[^\s=>"'/]+(?:\s*=\s*(?:{_VALUE}))?|\s*/)*?\s+{name}\s*=\s*({_VALUE})"""


def attribute(token: Column, name: str) -> Column:
    """The value of an attribute of a start tag; null where it has none."""
    found = F.when(token.contains("="), F.regexp_extract(token, attribute_pattern(name), 1))
    return F.when(found != "", F.regexp_replace(found, r"""^["']|["']$""", ""))


def kind(token: Column, tag: Column) -> Column:
    """Of a tag: end, raw, void or start."""
    return (
        F.when(token.startswith("</"), "end")
        .when(tag.isin(*RAW) & token.rlike(r"(?is)</[a-z]+\s*>$"), "raw")
        .when(tag.isin(*VOID) | token.endswith("/>"), "void")
        .otherwise("start")
    )


def _strings(values: tuple[str, ...] = ()) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _rule(i: Column, tag: Column, kind: Column) -> Column:
    """A tag's place, name, kind and rule: -1 closes what its name opened, others are numbers in IMPLIED from 1, 0 closes nothing."""
    rule = F.when(kind == "end", -1)
    for number, (tags, _, _) in enumerate(IMPLIED, 1):
        rule = rule.when(tag.isin(*tags), number)
    return F.struct(i.alias("i"), tag.alias("tag"), kind.alias("kind"), rule.otherwise(0).alias("rule"))


def _by_rule(k: Column, own: Column, which: int) -> Column:
    out = F.when(k["rule"] == -1, own)
    for number, rule in enumerate(IMPLIED, 1):
        out = out.when(k["rule"] == number, _strings(rule[which]))
    return out


def _last(tags: Column, wanted: Column) -> Column:
    """The place, from 1, of the last tag that is wanted; 0 without one."""
    return F.coalesce(F.array_max(F.transform(tags, lambda t, i: F.when(F.array_contains(wanted, t), i + 1).otherwise(0))), F.lit(0))


def _step(a: Column, k: Column) -> Column:
    """One tag: a(tags, ids, turn, out) holds the open elements; out gets the tag's parent, depth, number among those that opened, and what it closed."""
    n = F.size(a["tags"])
    pushes = k["kind"] == "start"

    def event(parent: Column, depth: Column, closed: Column) -> Column:
        return F.concat(a["out"], F.array(F.struct(parent.alias("parent"), depth.alias("depth"), a["turn"].alias("turn"), closed.alias("closed"))))

    def after(tags: Column, ids: Column, depth: Column, closed: Column) -> Column:
        parent = F.coalesce(F.get(a["ids"], depth - 1), F.lit(-1))
        return F.when(
            pushes,
            F.struct(F.concat(tags, F.array(k["tag"])).alias("tags"), F.concat(ids, F.array(k["i"])).alias("ids"), (a["turn"] + 1).alias("turn"), event(parent, depth, closed).alias("out")),
        ).otherwise(F.struct(tags.alias("tags"), ids.alias("ids"), a["turn"].alias("turn"), event(parent, depth, closed).alias("out")))

    def closing(c: Column) -> Column:
        return after(F.slice(a["tags"], 1, c - 1), F.slice(a["ids"], 1, c - 1), c - 1, F.slice(a["ids"], c, n + 1 - c))

    nothing = after(a["tags"], a["ids"], n, F.array().cast("array<int>"))
    closes, shields = _by_rule(k, F.array(k["tag"]), 1), _by_rule(k, _strings(), 2)
    first = let(_last(a["tags"], closes), lambda c: F.when((c > 0) & ((k["rule"] == -1) | (c > _last(a["tags"], shields))), c).otherwise(0))
    return F.when(k["rule"] == 0, nothing).otherwise(passing(a, first, lambda c: F.when(c == 0, nothing).otherwise(closing(c))))


_EVENT = "struct<parent:int,depth:int,turn:int,closed:array<int>>"
_NODE = "struct<node_id:int,parent_id:int,exit:int,depth:int,tag:string>"


def trees(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html", texts: bool = True) -> DataFrame:
    """The columns ``keep``, tokens array<string> and nodes array<struct<node_id,parent_id,exit,depth,tag>> in order: a row a page.
    Without ``texts`` the nodes are elements alone."""
    cells = pages.select(*keep, F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0)).alias("tokens"))
    n = F.size("tokens")

    # What is no tag moves no stack: it stays outside of the fold.
    def named(t: Column, i: Column) -> Column:
        item = lambda tag: F.when(tag != "", let(kind(t, tag), lambda k: _rule(i, tag, k)))
        return F.when(t.startswith("<"), let(F.lower(F.regexp_extract(t, TAG, 1)), item))

    cells = cells.withColumn("items", F.array_compact(F.transform("tokens", named)))
    none = F.struct(_strings().alias("tags"), F.array().cast("array<int>").alias("ids"), F.lit(0).alias("turn"), F.array().cast(f"array<{_EVENT}>").alias("out"))
    held = ("tags", "ids", "turn")
    start = F.struct(*(none[c].alias(c) for c in held), F.array().cast(f"array<array<{_EVENT}>>").alias("outs"))

    def whole(a: Column, at: Column) -> Column:
        inner = F.struct(*(a[c].alias(c) for c in held), none["out"].alias("out"))
        done = F.aggregate(F.slice("items", at + 1, BLOCK), inner, _step)
        return passing(a, done, lambda d: F.struct(*(d[c].alias(c) for c in held), F.concat(a["outs"], F.array(d["out"])).alias("outs")))

    m = F.size("items")
    blocks = F.when(m > 0, F.sequence(F.lit(0), m - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    cells = cells.withColumn("folded", F.aggregate(blocks, start, whole))
    cells = cells.select(*keep, "tokens", "items", F.flatten("folded.outs").alias("events"), F.col("folded.ids").alias("open"))
    # An element and its exit as one number, so that sorting puts them in order of elements, as those were opened.
    ended_at = lambda c, exit_: F.shiftleft(c.cast("long"), 31) + exit_
    ended = F.zip_with("events", "items", lambda e, k: F.transform(e["closed"], lambda c: ended_at(c, k["i"] - 1)))
    exits = F.sort_array(F.concat(F.flatten(ended), F.transform("open", lambda c: ended_at(c, n - 1))))
    cells = cells.withColumn("exits", exits)

    def element(e: Column, k: Column) -> Column:
        exit_ = F.when(k["kind"] == "start", F.get("exits", e["turn"]).bitwiseAND(F.lit(2**31 - 1)).cast("int")).otherwise(k["i"])
        return F.when(k["kind"] != "end", F.struct(k["i"].alias("node_id"), e["parent"].alias("parent_id"), exit_.alias("exit"), e["depth"].alias("depth"), k["tag"].alias("tag")))

    elements_ = F.array_compact(F.zip_with("events", "items", element))
    if not texts:
        return cells.select(*keep, "tokens", elements_.cast(f"array<{_NODE}>").alias("nodes"))

    def between(first: Column, last: Column, parent: Column, depth: Column) -> Column:
        """The texts among the tokens from first to last."""
        at = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        shown = F.filter(at, lambda i: (~F.get("tokens", i).startswith("<!")) & F.get("tokens", i).rlike(r"[^\s]"))
        return F.transform(shown, lambda i: F.struct(i.alias("node_id"), parent.alias("parent_id"), i.alias("exit"), depth.alias("depth"), F.lit("#text").alias("tag")))

    def behind(e: Column, j: Column) -> Column:
        k, following = F.get("items", j), F.coalesce(F.get("items", j + 1)["i"], n)
        pushes = (k["kind"] == "start").cast("int")
        return between(k["i"] + 1, following - 1, F.when(pushes == 1, k["i"]).otherwise(e["parent"]), e["depth"] + pushes)

    ahead = between(F.lit(0), F.coalesce(F.get("items", F.lit(0))["i"], n) - 1, F.lit(-1), F.lit(0))
    every = F.concat(elements_.cast(f"array<{_NODE}>"), ahead.cast(f"array<{_NODE}>"), F.flatten(F.transform("events", behind)).cast(f"array<{_NODE}>"))
    return cells.select(*keep, "tokens", F.sort_array(every).alias("nodes"))


def inner_text(node: Column) -> Column:
    """The text inside of a node of ``tokens``; white space runs are one space, and none stands at its ends."""
    inside = F.slice("tokens", node["node_id"] + 2, node["exit"] - node["node_id"])
    texts = F.filter(inside, lambda t: ~t.startswith("<") | (t == "<"))
    return F.btrim(F.regexp_replace(F.array_join(texts, ""), r"\s+", " "))


def elements(trees: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), only: Callable[[Column], Column] | None = None, texts: tuple[str, ...] = ()) -> DataFrame:
    """A row a node that ``only`` takes: ``keep``, node_id, parent_id, exit, depth, tag, token, and the inner text of tags in ``texts`` (else null)."""
    nodes = F.filter("nodes", only) if only else F.col("nodes")
    text = lambda x: F.when(x["tag"].isin(*texts), inner_text(x)) if texts else F.lit(None).cast("string")
    # Rows are finished before they leave their page's array, so that no page is copied to each of them.
    rows = F.transform(nodes, lambda x: F.struct(x["node_id"].alias("node_id"), x["parent_id"].alias("parent_id"), x["exit"].alias("exit"), x["depth"].alias("depth"), x["tag"].alias("tag"), F.get("tokens", x["node_id"]).alias("token"), text(x).alias("text")))
    return trees.select(*keep, F.explode(rows).alias("x")).select(*keep, "x.*")
