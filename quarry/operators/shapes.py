"""Types: what duplicates what, what resembles what, what is used, and what is too complex.

types: path, name, kind (Interface, TypeAlias, Enum, Class), head (what follows the name: supertypes, or an alias's type),
properties and methods (arrays of "name:type"), as code.type_definitions gives them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.text import common_prefix, round_half_up
from quarry.operators import audits as A
from quarry.operators import graph as G

#: Ends of names that tell one use of a type, and names that say nothing (fixed values).
SPECIFIC = r"(?:Props|State|Config|Schema|Request|Response|Event|Handler)$"
GENERIC = ("Props", "State", "Data", "Type", "Item", "Config", "Options", "Params", "Result", "Response", "Request", "Value", "Node", "Info")
WRAPPERS = r"^(Partial|Pick|Omit|Record)\s*<"


def _names(column: str) -> Column:
    return F.transform(column, lambda x: F.substring_index(x, ":", 1))


def union_members(head: Column) -> Column:
    """The parts of a type between the | signs outside of brackets."""
    flat = reduce(lambda c, _: F.regexp_replace(c, r"\{[^{}]*\}|\([^()]*\)|<[^<>]*>|\[[^\[\]]*\]", "_"), range(4), head)
    return F.filter(F.transform(F.split(flat, r"\|"), lambda x: F.btrim(x)), lambda x: x != "")


def size_class(kind: Column, head: Column, members: Column) -> Column:
    """How large a type is, in words: simple, medium or complex, and of what."""
    n = F.size(union_members(head))
    literal = head.rlike(r"^\s*\{")
    # Members of a literal type: separated by ; or , at its own level.
    inner = reduce(lambda c, _: F.regexp_replace(c, r"\{[^{}]*\}", "_"), range(3), F.regexp_replace(F.btrim(head), r"^\{|\}$", ""))
    fields = F.size(F.filter(F.split(inner, "[;,]"), lambda x: F.btrim(x) != ""))
    step = lambda x, low, high, what: F.when(x <= low, f"simple-{what}").when(x <= high, f"medium-{what}").otherwise(f"complex-{what}")
    alias = F.when(~literal & (n > 1), step(n, 3, 7, "union")).when(literal, step(fields, 3, 10, "object")).otherwise("simple-alias")
    return F.when(kind == "TypeAlias", alias).when(kind == "Interface", step(members, 3, 10, "interface")).when(kind == "Enum", F.when(members <= 5, "simple-enum").otherwise("complex-enum")).otherwise("unknown")


def place(path: Column) -> Column:
    return reduce(lambda c, x: c.when(path.contains(f"/{x}/"), f"{x}-dir"), ("types", "components", "api", "utils"), F).otherwise("other")


def keyed(types: DataFrame) -> DataFrame:
    """types with signature (kind and shape), size_class and place: duplicates must agree in all three."""
    members = F.size("properties") + F.size("methods")
    body = F.when(members > 0, F.concat_ws(";", F.array_join("properties", ","), F.array_join("methods", ","))).otherwise(F.regexp_replace(F.coalesce("head", F.lit("")), r"\s+", ""))
    return types.withColumns({"signature": F.sha2(F.concat_ws("|", "kind", body), 256), "size_class": size_class(F.col("kind"), F.coalesce("head", F.lit("")), members), "place": place(F.col("path"))})


def duplicate_groups(types: DataFrame) -> DataFrame:
    """group (a hash), n, n_names, n_folders, names: types of one shape, size class and place that are defined more than once."""
    rows = keyed(types).withColumn("group", F.substring(F.sha2(F.concat_ws("|", "signature", "size_class", "place"), 256), 1, 16))
    g = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("n_names"), F.countDistinct(P.dirname(F.col("path"))).alias("n_folders"), F.sort_array(F.collect_set("name")).alias("names"),
    )
    return g.where("n > 1")


def primaries(types: DataFrame, usage: DataFrame) -> DataFrame:
    """group, name, path, primary: members of duplicate groups of several names; the primary one lies in a folder of shared types, isn't
    derived from a schema, is used most, has a name without a telling end, then the first by name and path. usage(path, name, n)."""
    rows = keyed(types).withColumn("group", F.substring(F.sha2(F.concat_ws("|", "signature", "size_class", "place"), 256), 1, 16)).join(usage, ["path", "name"], "left")
    shared = F.col("path").rlike("/(types|shared)/")
    derived = F.coalesce(F.col("head").rlike(r"z\.infer|z\.input|z\.output"), F.lit(False))
    order = [F.desc(shared), F.asc(derived), F.desc(F.coalesce("n", F.lit(0))), F.asc(F.col("name").rlike(SPECIFIC)), "name", "path"]
    ranked = rows.withColumn("turn", F.row_number().over(W.partitionBy("group").orderBy(*order)))
    several = duplicate_groups(types).where("n_names > 1").select("group")
    return ranked.join(several, "group", "left_semi").select("group", "name", "path", (F.col("turn") == 1).alias("primary"))


def overlap(pairs: DataFrame) -> DataFrame:
    """pairs(a, b, pa, pb, ma, mb: arrays of names) with common, only_a, only_b of the properties, and whether a has all that b has."""
    subtype = (F.size(F.array_except("pb", "pa")) == 0) & (F.size(F.array_except("mb", "ma")) == 0)
    return pairs.select(
        "a", "b", F.sort_array(F.array_intersect("pa", "pb")).alias("common"), F.sort_array(F.array_except("pa", "pb")).alias("only_a"), F.sort_array(F.array_except("pb", "pa")).alias("only_b"), subtype.alias("a_is_subtype"),
    )


def similar_groups(types: DataFrame, above: float = 0.5) -> DataFrame:
    """path, name, group, exact: types with equal sets of property names, else types linked by a Jaccard similarity of these sets above
    the limit, of one kind. Sets meet by their rarest names, so that a frequent name doesn't make all pairs; no cap on comparisons."""
    own = types.select("path", "name", "kind", F.array_distinct(_names("properties")).alias("ps")).where("size(ps) > 0").withColumn("id", F.concat_ws("#", "path", "name"))
    exact = own.withColumn("set", F.array_join(F.sort_array("ps"), ",")).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("set")))
    same = exact.where("n > 1").withColumn("group", F.min("id").over(W.partitionBy("set"))).select("path", "name", "group", F.lit(True).alias("exact"))
    rest = exact.where("n = 1").select("id", "kind", "ps")
    counts = rest.select("kind", F.explode("ps").alias("x")).groupBy("kind", "x").agg(F.count(F.lit(1)).alias("c"))
    ranked = rest.select("id", "kind", "ps", F.explode("ps").alias("x")).join(counts, ["kind", "x"]).groupBy("id", "kind").agg(F.first("ps").alias("ps"), F.sort_array(F.collect_list(F.struct("c", "x"))).alias("o"))
    keep = (F.size("ps") - F.ceil(F.size("ps") * above) + 1).cast("int")
    index = ranked.select("id", "kind", "ps", F.explode(F.slice("o", 1, keep)).alias("e")).select("id", "kind", "ps", "e.x")
    other = index.select(F.col("id").alias("id2"), F.col("kind").alias("kind2"), F.col("ps").alias("ps2"), F.col("x").alias("x2"))
    met = index.join(other, (F.col("x") == F.col("x2")) & (F.col("kind") == F.col("kind2")) & (F.col("id") < F.col("id2")) & (F.least(F.size("ps"), F.size("ps2")) > above * F.greatest(F.size("ps"), F.size("ps2"))))
    links = met.where(A.jaccard(F.col("ps"), F.col("ps2")) > above).select(F.col("id").alias("src"), F.col("id2").alias("dst")).distinct()
    linked = G.components(links).select(F.substring_index("node", "#", 1).alias("path"), F.substring_index("node", "#", -1).alias("name"), "group", F.lit(False).alias("exact"))
    return same.union(linked)


def unified(members: DataFrame, types: DataFrame, most: int = 10) -> DataFrame:
    """group, suggested, properties, folder, n: for the largest groups a type that holds what all their members hold; members(path, name,
    group). A property with several types becomes their union; the name is the common start, else the first name, with Base."""
    rows = members.select("path", "name", "group").join(types.select("path", "name", "properties"), ["path", "name"])
    fields = rows.select("group", F.explode("properties").alias("p")).select("group", F.substring_index("p", ":", 1).alias("field"), F.expr("substring(p, instr(p, ':') + 1)").alias("type"))
    merged = fields.groupBy("group", "field").agg(F.array_join(F.sort_array(F.collect_set("type")), " | ").alias("type")).groupBy("group").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "field", "type"))), "; ").alias("properties"))
    names = rows.groupBy("group").agg(F.sort_array(F.collect_list("name")).alias("names"), F.sort_array(F.collect_set(P.dirname(F.col("path")))).alias("folders"), F.count(F.lit(1)).alias("n"))
    # Of sorted texts the first and the last share what all share.
    start = common_prefix(F.get("names", F.lit(0)), F.element_at("names", -1))
    shared = F.get(F.filter("folders", lambda f: F.concat(f, F.lit("/")).contains("/types/")), F.lit(0))
    common = F.regexp_replace(common_prefix(F.get("folders", F.lit(0)), F.element_at("folders", -1)), "/[^/]*$", "")
    folder = F.coalesce(shared, F.concat_ws("/", F.when(F.size("folders") > 1, common).otherwise(F.get("folders", F.lit(0))), F.lit("types")))
    out = names.join(merged, "group").select("group", F.concat(F.when(F.length(start) > 3, start).otherwise(F.get("names", F.lit(0))), F.lit("Base")).alias("suggested"), "properties", folder.alias("folder"), "n")
    return out.orderBy(F.desc("n"), "group").limit(most)


def complex_types(types: DataFrame, most: int | None = 100) -> DataFrame:
    """path, name, form, members, depth, broad, simplify: unions, intersections, literals and wrapped types. A union is broad from six
    members on; it could be simpler with null or undefined among them, with more than three texts alone, or nested more than twice.
    ``most`` rows, the most members first; None for all."""
    head = F.btrim(F.coalesce("head", F.lit("")))
    n = F.size(union_members(head))
    flat = reduce(lambda c, _: F.regexp_replace(c, r"\{[^{}]*\}|\([^()]*\)|<[^<>]*>", "_"), range(4), head)
    both = F.size(F.split(flat, "&"))
    form = F.when(n > 1, "union").when(both > 1, "intersection").when(head.startswith("{"), "literal").when(head.rlike(WRAPPERS), "wrapper")
    opens = F.split(head, "")
    depth = F.aggregate(opens, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, c: F.struct(
        (s.now + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("now"), F.greatest(s.most, s.now + F.when(c == "{", 1).otherwise(0)).alias("most")), lambda s: s.most)
    texts = F.forall(union_members(head), lambda x: x.rlike("^['\"].*['\"]$"))
    simpler = ((n > 1) & F.exists(union_members(head), lambda x: x.isin("null", "undefined"))) | ((n > 3) & texts) | (depth > 2)
    members = F.when(n > 1, n).otherwise(both)
    rows = types.where("kind = 'TypeAlias'").select("path", "name", form.alias("form"), members.alias("members"), depth.alias("depth"), (n > 5).alias("broad"), simpler.alias("simplify")).where("form is not null")
    return rows if most is None else rows.orderBy(F.desc("members"), F.desc("depth"), "path", "name").limit(most)


def type_words(nodes: DataFrame) -> DataFrame:
    """path, word, n: the names that types are spelled with: of members, parameters, variables, results, supertypes and aliases."""
    spelled = (
        F.when(F.col("kind").isin("Property", "Method", "Parameter", "TypeAlias", "Interface", "Class"), F.col("text"))
        .when(F.col("kind") == "Variable", F.regexp_replace("text", "^(const|let|var)", ""))
        .when(F.col("kind") == "ReturnType", F.col("name"))
    )
    words = nodes.select("path", F.explode(F.regexp_extract_all(F.coalesce(spelled, F.lit("")), F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))).alias("word"))
    return words.groupBy("path", "word").agg(F.count(F.lit(1)).alias("n"))


def usage(types: DataFrame, words: DataFrame) -> DataFrame:
    """path, name, n: by how many other files each type is used."""
    used = words.select(F.col("path").alias("by"), F.col("word").alias("name"))
    met = types.select("path", "name").distinct().join(used, "name").where("by <> path").groupBy("path", "name").agg(F.countDistinct("by").alias("n"))
    return types.select("path", "name").distinct().join(met, ["path", "name"], "left").select("path", "name", F.coalesce("n", F.lit(0)).alias("n"))


def unused(counted: DataFrame) -> DataFrame:
    return counted.where("n = 0").select("path", "name")


def any_uses(words: DataFrame) -> DataFrame:
    return words.where("word = 'any'").select("path", "n")


def generic_names(types: DataFrame) -> DataFrame:
    """path, name of types whose name says nothing, or a short one for props or state."""
    short = F.col("name").rlike("(Props|State)$") & (F.length("name") < 10)
    return types.where(F.col("name").isin(*GENERIC) | short).select("path", "name")


def component_typing(functions: DataFrame, components: DataFrame) -> DataFrame:
    """path, name, is_component, typed_props, untyped_result: components whose parameters have types, functions without a result type."""
    own = components.select("path", "name", F.lit(True).alias("is_component")).distinct()
    typed = F.exists("params", lambda p: F.coalesce(p.type, F.lit("")) != "")
    rows = functions.where("name <> 'anonymous'").join(own, ["path", "name"], "left").withColumn("is_component", F.coalesce("is_component", F.lit(False)))
    return rows.select("path", "name", "is_component", F.when(F.col("is_component") & (F.size("params") > 0), typed).alias("typed_props"), (~F.col("is_component") & (F.col("return_type") == "unknown")).alias("untyped_result"))


def suggestions(groups: DataFrame, complexes: DataFrame, never: DataFrame, anys: DataFrame) -> DataFrame:
    """kind, subject, text: one sentence for each finding on types."""
    a = groups.select(F.lit("duplicate").alias("kind"), F.array_join("names", ", ").alias("subject"), F.format_string("%s are the same type %d times: keep one definition.", F.array_join("names", ", "), F.col("n")).alias("text"))
    b = complexes.where("simplify").select(F.lit("complex"), F.concat_ws("#", "path", "name"), F.format_string("%s is %s of %d members: give its parts names.", F.col("name"), F.when(F.col("form") == "intersection", "an intersection").otherwise(F.concat(F.lit("a "), F.col("form"))), F.col("members")))
    c = never.select(F.lit("unused"), F.concat_ws("#", "path", "name"), F.format_string("%s is used by no other file.", F.col("name")))
    d = anys.select(F.lit("any"), F.col("path"), F.format_string("any is used %d times.", F.col("n")))
    return a.union(b).union(c).union(d)


def mean_similarity(links: DataFrame) -> DataFrame:
    return links.groupBy("group").agg(round_half_up(F.avg("score"), 2).alias("score"))
