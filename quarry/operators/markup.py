"""What pages say through their trees: containment, accessibility rules, summaries over grouping sets, repeated subtrees, pages of one template."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import let, passing
from quarry.operators import graph as G
from quarry.operators.code import LEVEL_AA, PENALTIES, ROLES, compliance
from quarry.sources.markup import attribute

#: Tags whose inner text the rules look at.
TEXTED = ("a", "button", "h1", "h2", "h3", "h4", "h5", "h6", "label", "legend", "option")
#: Link texts that say nothing, words that stand for no description (fixed values).
VAGUE = ("click here", "here", "learn more", "link", "more", "read more", "this")
PLACEHOLDERS = ("icon", "image", "photo", "picture")


def contained(outer: DataFrame, inner: DataFrame, by: str = "page_id", width: int = 256) -> DataFrame:
    """by, node_id, inner_id: the nodes of inner that lie inside of a node of outer. Both have by, node_id and exit.

    An outer node stands in each block of ``width`` places that it reaches into, an inner one in its own, so that the join's key is a
    page's block and no page is one key."""
    block = lambda c: F.floor(F.col(c) / width)
    a = outer.select(by, F.col("node_id"), "exit", F.explode(F.sequence(block("node_id"), block("exit"))).alias("block"))
    b = inner.select(by, F.col("node_id").alias("inner_id"), block("node_id").alias("block"))
    return a.join(b, [by, "block"]).where("inner_id > node_id and inner_id <= exit").select(by, "node_id", "inner_id")


def findings(nodes: DataFrame, by: str = "page_id") -> DataFrame:
    """by, node_id, tag, rule, severity over element rows with token and text (of TEXTED): rules that an element decides in one projection, then
    those that need an element's surroundings, then those that need the page's order."""
    tag, text = F.col("tag"), F.coalesce("text", F.lit(""))
    p = lambda name: F.col(f"at_{name}")
    names = ("alt", "id", "for", "type", "title", "placeholder", "role", "lang", "onclick", "aria-label", "aria-labelledby", "aria-hidden", "aria-expanded", "tabindex")
    rows = nodes.where("tag <> '#text'").withColumns({f"at_{n}": attribute(F.col("token"), n) for n in names})
    named = p("aria-label").isNotNull() | p("aria-labelledby").isNotNull() | p("title").isNotNull()
    v = lambda condition, rule, severity: F.when(condition, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))
    own = F.array(
        v((tag == "img") & p("alt").isNull(), "img-alt", "error"),
        v((tag == "img") & F.lower(p("alt")).isin(*PLACEHOLDERS), "img-alt-meaningful", "warning"),
        v((tag == "button") & (text == "") & ~named, "button-text", "error"),
        v((tag == "a") & (text == "") & ~named, "link-text", "error"),
        v((tag == "a") & (F.lower(text).isin(*VAGUE) | ((F.length(text) < 3) & (text != ""))), "link-text-descriptive", "warning"),
        v(p("role").isNotNull() & F.exists(F.split(p("role"), r"\s+"), lambda r: (r != "") & ~r.isin(*ROLES)), "aria-role-valid", "error"),
        v(~tag.isin("a", "button", "details", "input", "select", "summary", "textarea") & p("onclick").isNotNull() & p("role").isNull(), "interactive-role", "warning"),
        v((tag == "html") & p("lang").isNull(), "html-lang", "error"),
        v((tag == "html") & p("lang").isNotNull() & ~p("lang").rlike("^[a-z]{2,3}(-[A-Za-z0-9]+)*$"), "html-lang", "warning"),
        v(~F.coalesce(p("aria-hidden"), F.lit("true")).isin("true", "false"), "aria-hidden-value", "error"),
        v(~F.coalesce(p("aria-expanded"), F.lit("true")).isin("true", "false"), "aria-expanded-value", "error"),
    )
    alone = rows.select(by, "node_id", "tag", F.explode(F.array_compact(own)).alias("r")).select(by, "node_id", "tag", "r.rule", "r.severity")

    fields = rows.where((tag == "input") & ~F.coalesce(p("type"), F.lit("")).isin("hidden", "submit", "button")).select(by, "node_id", "exit", "tag", p("id").alias("id"), named.alias("named"), p("placeholder").isNotNull().alias("placeholder"))
    labels = rows.where("tag = 'label'").select(by, "node_id", "exit", p("for").alias("target"))
    around = contained(labels, fields, by).select(by, F.col("inner_id").alias("node_id"), F.lit(True).alias("around")).distinct()
    called = labels.where("target is not null").select(by, F.col("target").alias("id"), F.lit(True).alias("called")).distinct()
    fields = fields.join(around, [by, "node_id"], "left").join(called, [by, "id"], "left").fillna(False, ["around", "called"])
    bare = ~F.col("named") & ~F.col("around") & ~F.col("called")
    unlabelled = fields.where(bare | (F.col("placeholder") & ~F.col("named"))).select(by, "node_id", "tag", F.lit("input-label").alias("rule"), F.when(bare, "error").otherwise("warning").alias("severity"))

    sets = rows.where("tag = 'fieldset'").select(by, "node_id", "tag", named.alias("named"))
    legends = rows.where("tag = 'legend'").select(by, F.col("parent_id").alias("node_id")).distinct()
    unnamed = sets.join(legends, [by, "node_id"], "left_anti").select(by, "node_id", "tag", F.lit("fieldset-legend").alias("rule"), F.when(F.col("named"), "info").otherwise("warning").alias("severity"))

    heads = rows.where(tag.rlike("^h[1-6]$")).select(by, "node_id", "tag", F.substring("tag", 2, 1).cast("int").alias("level"))
    heads = heads.withColumn("before", F.lag("level").over(W.partitionBy(by).orderBy("node_id")))
    first = F.col("before").isNull()
    order = heads.where((first & (F.col("level") != 1)) | (F.col("level") > F.col("before") + 1)).select(by, "node_id", "tag", F.when(first, "heading-hierarchy-start").otherwise("heading-hierarchy-skip").alias("rule"), F.lit("warning").alias("severity"))

    ids = rows.where(p("id").isNotNull() & (p("id") != "")).select(by, "node_id", "tag", p("id").alias("id"))
    twice = ids.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(by, "id"))).where("n > 1").select(by, "node_id", "tag", F.lit("duplicate-id").alias("rule"), F.lit("error").alias("severity"))
    return reduce(DataFrame.unionByName, [alone, unlabelled, unnamed, order, twice])


def summaries(found: DataFrame) -> DataFrame:
    """level (total, severity, rule, host, host and severity), host, rule, severity, findings, pages: all summaries of findings (page_id, host, rule,
    severity) in one pass over grouping sets. Pages are counted once for each."""
    # A page's findings are put together first, so that what is counted for the sets is a row a page, rule and severity.
    per = found.groupBy("page_id", "host", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))
    grouped = per.groupingSets([[], [F.col("severity")], [F.col("rule")], [F.col("host")], [F.col("host"), F.col("severity")]], "host", "rule", "severity").agg(
        F.grouping_id().alias("set"), F.sum("n").alias("findings"), F.countDistinct("page_id").alias("pages")
    )
    level = F.element_at(F.create_map(*(F.lit(x) for k, name in ((7, "total"), (6, "severity"), (5, "rule"), (3, "host"), (2, "host and severity")) for x in (k, name))), F.col("set").cast("int"))
    return grouped.select(level.alias("level"), "host", "rule", "severity", "findings", "pages")


def scores(nodes: DataFrame, found: DataFrame, by: str = "page_id") -> DataFrame:
    """by, elements, violations, score, level: the share of elements without a finding, less twice the penalties (fifty at most)."""
    n = nodes.where("tag <> '#text'").groupBy(by).agg(F.count(F.lit(1)).alias("elements"))
    cost = sum((F.when(F.col("severity") == s, w).otherwise(0) for s, w in PENALTIES.items()), F.lit(0))
    error, aa = F.col("severity") == "error", F.col("rule").isin(*LEVEL_AA)
    per = found.groupBy(by, "node_id").agg(F.count(F.lit(1)).alias("n"), F.sum(cost).alias("cost"), F.count_if(error).alias("errors"), F.count_if(error & ~aa).alias("a_errors"), F.count_if((F.col("severity") == "warning") & aa).alias("aa_warnings"))
    v = per.groupBy(by).agg(F.sum("n").alias("violations"), F.count(F.lit(1)).alias("hit"), *(F.sum(c).alias(c) for c in ("cost", "errors", "a_errors", "aa_warnings")))
    rows = n.join(v, by, "left").fillna(0)
    score = F.greatest(F.lit(0), F.floor((F.col("elements") - F.col("hit")) / F.col("elements") * 100 - F.least(2 * F.col("cost"), F.lit(50)) + 0.5))
    return rows.select(by, "elements", "violations", score.cast("long").alias("score"), compliance(F.col("errors"), F.col("a_errors"), F.col("aa_warnings")).alias("level"))


_DIGEST = "struct<node_id:int,parent_id:int,size:int,digest:string>"


def subtrees(trees: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep, node_id, parent_id, size (elements in it), digest: a Merkle digest of each element's subtree, of tags alone, from leaves up.

    Elements are taken from the last to the first. What waits on the stack one level deeper than an element are its children, as those of
    later elements have been taken away by their parents."""
    items = F.filter("nodes", lambda x: x["tag"] != "#text")
    held = "array<struct<depth:int,size:int,digest:string>>"

    def step(a: Column, x: Column) -> Column:
        def with_children(children: Column) -> Column:
            digest = F.md5(F.concat(x["tag"], F.lit("("), F.array_join(F.transform(F.reverse(children), lambda c: c["digest"]), ","), F.lit(")")).cast("binary"))
            size = F.aggregate(children, F.lit(1), lambda s, c: s + c["size"])

            def done(d: Column) -> Column:
                waiting = F.concat(F.slice(a["held"], 1, F.size(a["held"]) - F.size(children)), F.array(F.struct(x["depth"].alias("depth"), d["size"].alias("size"), d["digest"].alias("digest"))))
                return F.struct(waiting.alias("held"), F.concat(a["out"], F.array(F.struct(x["node_id"].alias("node_id"), x["parent_id"].alias("parent_id"), d["size"].alias("size"), d["digest"].alias("digest")))).alias("out"))

            return passing(a, F.struct(size.alias("size"), digest.alias("digest")), done)

        return passing(a, F.filter(a["held"], lambda h: h["depth"] == x["depth"] + 1), with_children)

    def block(a: Column, at: Column) -> Column:
        inner = F.struct(a["held"].alias("held"), F.array().cast(f"array<{_DIGEST}>").alias("out"))
        return passing(a, F.aggregate(F.slice(F.col("items"), at + 1, 64), inner, step), lambda d: F.struct(d["held"].alias("held"), F.concat(a["outs"], F.array(d["out"])).alias("outs")))

    rows = trees.select(*keep, F.reverse(items).alias("items"))
    n = F.size("items")
    blocks = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(64))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.array().cast(held).alias("held"), F.array().cast(f"array<array<{_DIGEST}>>").alias("outs"))
    out = F.aggregate(blocks, start, block, lambda a: F.flatten(a["outs"]))
    return rows.select(*keep, F.explode(out).alias("x")).select(*keep, "x.*")


def repeated_subtrees(found: DataFrame, least: int = 3, by: str = "page_id") -> DataFrame:
    """digest, size, copies, pages, first_page, first_node of maximal repeated subtrees: shapes of ``least`` elements and more that occur more
    than once, and not only inside of a larger shape that occurs as often. Copies meet by digest, never by pairs."""
    found = G.checkpointed(found)  # used twice: no tree is built again
    big = found.where(F.col("size") >= least)
    # Copies of a page are counted before they meet, so that a shape that a page repeats is one row.
    per = big.groupBy("digest", by).agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("node_id"), F.max("size").alias("size"))
    groups = per.groupBy("digest").agg(F.sum("n").alias("copies"), F.count(F.lit(1)).alias("pages"), F.min(F.struct(F.col(by).alias("page"), "node_id")).alias("first"), F.max("size").alias("size")).where("copies > 1")
    # A shape that always stands in one larger shape, as often as that one occurs, is no maximal one.
    up = found.select(by, F.col("node_id").alias("parent_id"), F.col("digest").alias("above"))
    inside = big.join(up, [by, "parent_id"]).groupBy("digest", "above").agg(F.count(F.lit(1)).alias("n"))
    covered = inside.join(groups.select(F.col("digest").alias("above"), F.col("copies").alias("times")), "above").join(groups.select("digest", "copies"), "digest").where("n = copies and times = copies").select("digest").distinct()
    return groups.join(covered, "digest", "left_anti").select("digest", "size", "copies", "pages", F.col("first.page").alias("first_page"), F.col("first.node_id").alias("first_node"))


def bags(trees: DataFrame, by: str = "page_id") -> DataFrame:
    """by, bag: how often each tag stands at each depth, as a sorted array of struct(item, n)."""
    items = F.transform(F.filter("nodes", lambda x: x["tag"] != "#text"), lambda x: F.concat_ws("@", x["tag"], x["depth"].cast("string")))
    counted = let(items, lambda i: F.transform(F.array_distinct(i), lambda x: F.struct(x.alias("item"), F.size(F.filter(i, lambda y: y == x)).alias("n"))))
    return trees.select(by, F.sort_array(counted).alias("bag"))


def alike_bags(found: DataFrame, percent: int = 80, by: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(a, b, common, total) of classes of equal bags whose weighted Jaccard index, sum of least over sum of greatest counts, is percent
    hundredths and more, and (by, bag_id) which page is of which class (its smallest page).

    An item that stands n times is n things, item and turn, so that the index of bags is one of sets. Things are ranked from rare to frequent,
    each class is known by the first of them (as many as an alike one can't do without), and classes meet by those; sizes that are too
    different don't."""
    found = G.checkpointed(found)  # used thrice: no tree is built again
    classes = G.checkpointed(found.where(F.size("bag") > 0).groupBy("bag").agg(F.min(by).alias("bag_id")))
    member = found.join(classes, "bag").select(by, "bag_id")
    size = F.aggregate("bag", F.lit(0), lambda s, x: s + x["n"])
    sized = classes.withColumn("size", size)
    things = sized.select("bag_id", "size", F.explode("bag").alias("x")).select("bag_id", "size", "x.item", F.explode(F.sequence(F.lit(1), F.col("x.n"))).alias("turn"))
    rank = things.groupBy("item", "turn").agg(F.count(F.lit(1)).alias("held"))
    order = F.row_number().over(W.partitionBy("bag_id").orderBy("held", "item", "turn"))
    keys = things.join(rank, ["item", "turn"]).withColumn("place", order)
    needed = F.floor(F.col("size") - F.ceil(F.col("size") * percent / 100)) + 1
    prefix = keys.where(F.col("place") <= needed).select("bag_id", "size", "item", "turn")
    a, b = (prefix.select(F.col("bag_id").alias(x), F.col("size").alias(f"{x}_size"), "item", "turn") for x in ("a", "b"))
    near = (F.col("a") < F.col("b")) & (F.col("a_size") * 100 >= F.col("b_size") * percent) & (F.col("b_size") * 100 >= F.col("a_size") * percent)
    pairs = a.join(b, ["item", "turn"]).where(near).select("a", "b", "a_size", "b_size").distinct()
    left, right = classes.select(F.col("bag_id").alias("a"), F.col("bag").alias("left")), classes.select(F.col("bag_id").alias("b"), F.col("bag").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    times = lambda bag, item: F.coalesce(F.get(F.filter(bag, lambda y: y["item"] == item), F.lit(0))["n"], F.lit(0))
    common = F.aggregate("left", F.lit(0), lambda s, x: s + F.least(x["n"], times(F.col("right"), x["item"])))
    scored = both.select("a", "b", common.alias("common"), (F.col("a_size") + F.col("b_size")).alias("sizes"))
    scored = scored.select("a", "b", "common", (F.col("sizes") - F.col("common")).alias("total"))
    return scored.where(F.col("common") * 100 >= F.col("total") * percent), member


