"""Facts and metrics of source code, over the node table that quarry.sources.syntax makes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import scoring

LOOPS = ("For", "While", "Do")
#: Kinds that add a path through a function.
PATHS = ("If", "Conditional", *LOOPS, "Case", "Catch", "Logical", "OptionalChain", "Nullish")


def functions(nodes: DataFrame) -> DataFrame:
    """path, node_id, exit, name, flavour, is_async, line, params, return_type: names come from the declaration, else from the variable,
    property or attribute that holds the function."""
    own = nodes.where("kind = 'Function'")
    parts = nodes.where("kind in ('Parameter', 'ReturnType')").groupBy("path", F.col("parent_id").alias("node_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "Parameter", F.struct(F.col("node_id").alias("i"), F.struct("name", F.col("text").alias("type")).alias("p"))))), lambda x: x.p).alias("params"),
        F.max(F.when(F.col("kind") == "ReturnType", F.col("name"))).alias("return_type"),
    )
    joined = own.join(parts, ["path", "node_id"], "left")
    return joined.select(
        "path", "node_id", "exit", "parent_id", "owner", F.coalesce("name", F.lit("anonymous")).alias("name"), F.col("text").alias("flavour"), F.col("text").contains("async").alias("is_async"), "line",
        F.coalesce("params", F.array().cast("array<struct<name:string,type:string>>")).alias("params"), F.coalesce("return_type", F.lit("unknown")).alias("return_type"),
    )


def jsx_choices(nodes: DataFrame) -> DataFrame:
    """path, owner, nesting: an entry for each expression in JSX that is a choice (&& or ?:)."""
    outer = nodes.where("kind = 'JsxExpression'").select("path", F.col("node_id").alias("parent_id"), "owner", "nesting")
    inner = nodes.where("kind = 'Conditional' or (kind = 'Logical' and name = '&&')").select("path", "parent_id").distinct()
    return outer.join(inner, ["path", "parent_id"], "left_semi").select("path", "owner", "nesting")


def complexity(nodes: DataFrame) -> DataFrame:
    """path, node_id, cyclomatic, cognitive for each function; node 0 stands for the code outside of functions.

    A nested function's code counts for itself alone. Cognitive complexity adds the nesting of each choice; ?? adds one."""
    kind = F.col("kind")
    nested = kind.isin("If", "Conditional", *LOOPS, "Switch", "Case", "Catch", "Logical")
    choices = jsx_choices(nodes).select("path", "owner", F.lit(1).alias("paths"), (F.col("nesting") + 1).alias("load"))
    own = nodes.select("path", "owner", F.when(kind.isin(*PATHS), 1).otherwise(0).alias("paths"), F.when(nested, F.col("nesting") + 1).when(kind == "Nullish", 1).otherwise(0).alias("load"))
    return own.union(choices).groupBy("path", F.col("owner").alias("node_id")).agg((F.sum("paths") + 1).alias("cyclomatic"), F.sum("load").alias("cognitive"))


def halstead(nodes: DataFrame) -> DataFrame:
    """path, operators and operands, distinct and in all, and the volume, by file."""
    role = F.when(F.col("kind").isin("Operator", "Unary", "Logical", "Nullish", "Call"), "operator").when(F.col("kind").isin("Identifier", "Number", "String"), "operand")
    used = nodes.select("path", role.alias("role"), F.coalesce("name", "text").alias("word")).where("role is not null")
    per = used.groupBy("path").agg(
        F.countDistinct(F.when(F.col("role") == "operator", F.col("word"))).alias("n1"), F.countDistinct(F.when(F.col("role") == "operand", F.col("word"))).alias("n2"),
        F.count_if(F.col("role") == "operator").alias("big_n1"), F.count_if(F.col("role") == "operand").alias("big_n2"),
    )
    return per.withColumn("volume", F.round(scoring.halstead_volume(F.col("big_n1") + F.col("big_n2"), F.col("n1") + F.col("n2")), 4))


def imports(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'Import'").select("path", F.col("name").alias("specifier"), F.filter(F.split("text", ","), lambda x: x != "").alias("names"), "line")


def exports(nodes: DataFrame) -> DataFrame:
    """path, name, is_default: names exported with their declaration or in a list."""
    e = nodes.where("kind = 'Export'").select("path", F.col("node_id").alias("parent_id"), F.col("name").alias("mark"), "text")
    child = nodes.where("kind in ('Function', 'Class', 'Variable', 'Interface', 'TypeAlias', 'Enum', 'Identifier')").select("path", "parent_id", F.col("name").alias("child"))
    listed = e.where("text is not null").select("path", F.explode(F.split("text", ",")).alias("name"), F.lit(False).alias("is_default"))
    held = e.where("text is null").join(child, ["path", "parent_id"]).select("path", F.col("child").alias("name"), (F.col("mark") == "default").alias("is_default"))
    return listed.where("name <> ''").union(held.select("path", F.coalesce("name", F.lit("default")), F.coalesce("is_default", F.lit(False))))


def components(nodes: DataFrame) -> DataFrame:
    """path, node_id, name, line: functions with a capital first letter that hold JSX, and classes that extend a component."""
    named = functions(nodes).where(F.col("name").rlike("^[A-Z]"))
    jsx = nodes.where("kind = 'JsxElement'").select(F.col("path").alias("p"), F.col("node_id").alias("at"))
    # Nesting is a range inside of one file.
    with_jsx = named.join(jsx, (F.col("path") == F.col("p")) & (F.col("at") > F.col("node_id")) & (F.col("at") <= F.col("exit")), "left_semi")
    classes = nodes.where("kind = 'Class' and text rlike 'extends\\\\s+(React\\\\.)?(Pure)?Component'")
    return with_jsx.select("path", "node_id", "name", "line").union(classes.select("path", "node_id", "name", "line"))


def elements(nodes: DataFrame) -> DataFrame:
    """path, node_id, exit, tag, props map, own_text, line, depth: a row for each JSX element."""
    tags = nodes.where("kind = 'JsxElement'").select("path", "node_id", "exit", "parent_id", F.col("name").alias("tag"), "line", "depth")
    attrs = nodes.where("kind = 'JsxAttribute'").groupBy("path", F.col("parent_id").alias("node_id")).agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("name", F.coalesce("text", F.lit("true")))))).alias("props")
    )
    text = nodes.where("kind = 'JsxText'").groupBy("path", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text"))), lambda x: x.text), " ").alias("own_text"))
    out = tags.join(attrs, ["path", "node_id"], "left").join(text, ["path", "node_id"], "left")
    return out.withColumns({"props": F.coalesce("props", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), "own_text": F.coalesce("own_text", F.lit(""))})


#: Roles of ARIA that a role attribute may name (fixed values, the ones in common use).
ROLES = (
    "alert alertdialog application article banner button cell checkbox columnheader combobox complementary contentinfo definition dialog directory document feed figure form grid "
    "gridcell group heading img link list listbox listitem log main marquee math menu menubar menuitem menuitemcheckbox menuitemradio navigation none note option presentation "
    "progressbar radio radiogroup region row rowgroup rowheader scrollbar search searchbox separator slider spinbutton status switch tab table tablist tabpanel term textbox timer "
    "toolbar tooltip tree treegrid treeitem"
).split()


def _inside(outer: DataFrame, inner: DataFrame, condition: Column, name: str) -> DataFrame:
    """outer's elements (path, node_id) that an element of inner lies inside of, or which a condition links; inside of a file."""
    a = outer.select("path", "node_id", "exit", F.col("props")["id"].alias("own_id"))
    b = inner.select(F.col("path").alias("p"), F.col("node_id").alias("other"), F.col("exit").alias("other_exit"), F.coalesce(F.col("props")["htmlFor"], F.col("props")["for"]).alias("label_for"))
    return a.join(b, (F.col("path") == F.col("p")) & condition, "left_semi").select("path", "node_id", F.lit(True).alias(name))


def accessibility_violations(found: DataFrame) -> DataFrame:
    """path, node_id, tag, rule, severity over elements: all rules in one projection, then one row a violation.

    An input has a label if one names its id or lies around it; a fieldset has a legend if one lies inside."""
    fields, labels = found.where("lower(tag) in ('input', 'select', 'textarea')"), found.where("lower(tag) = 'label'")
    around = (F.col("node_id") > F.col("other")) & (F.col("node_id") <= F.col("other_exit"))
    labelled = _inside(fields, labels, around | (F.col("own_id") == F.col("label_for")), "labelled")
    inside = (F.col("other") > F.col("node_id")) & (F.col("other") <= F.col("exit"))
    legends = _inside(found.where("lower(tag) = 'fieldset'"), found.where("lower(tag) = 'legend'"), inside, "legend")
    found = found.join(labelled, ["path", "node_id"], "left").join(legends, ["path", "node_id"], "left").fillna(False, ["labelled", "legend"])
    tag, text = F.lower("tag"), F.btrim("own_text")
    p = lambda name: F.col("props")[name]
    named = p("aria-label").isNotNull() | p("aria-labelledby").isNotNull()
    vague = F.lower(text).isin("click here", "read more", "learn more", "here", "more", "link")
    role = p("role")
    lang = p("lang")
    v = lambda condition, rule, severity: F.when(condition, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))
    children = F.col("props")["children"].isNotNull()
    rules = F.array(
        v((tag == "img") & p("alt").isNull(), "img-alt", "error"),
        v((tag == "img") & F.lower(p("alt")).isin("image", "picture", "photo", "icon"), "img-alt-meaningful", "warning"),
        v(tag.isin("input", "select", "textarea") & ~named & ~F.col("labelled") & p("title").isNull() & ~F.coalesce(p("type"), F.lit("")).isin("hidden", "submit", "button"), "input-label", "error"),
        v((tag == "input") & p("placeholder").isNotNull() & ~named & F.col("labelled") & p("title").isNull(), "input-label", "warning"),
        v((tag == "fieldset") & ~F.col("legend"), "fieldset-legend", "warning"),
        v((tag == "button") & (text == "") & ~named & ~children, "button-text", "error"),
        v((tag == "a") & (text == "") & ~named, "link-text", "error"),
        v((tag == "a") & vague, "link-text-descriptive", "warning"),
        v(role.isNotNull() & ~role.startswith("{") & F.exists(F.split(role, r"\s+"), lambda r: ~r.isin(*ROLES)), "aria-role-valid", "error"),
        v(tag.isin("div", "span") & p("onClick").isNotNull() & role.isNull(), "interactive-role", "warning"),
        v((tag == "html") & lang.isNull(), "html-lang", "error"),
        v((tag == "html") & lang.isNotNull() & ~lang.startswith("{") & ~lang.rlike("^[a-z]{2,3}(-[A-Za-z0-9]+)*$"), "html-lang", "warning"),
        v(~F.coalesce(p("aria-hidden"), F.lit("true")).isin("true", "false", "{true}", "{false}"), "aria-hidden-value", "error"),
        v(~F.coalesce(p("aria-expanded"), F.lit("true")).rlike(r"^(true|false|undefined|\{.*\})$"), "aria-expanded-value", "error"),
        v(F.coalesce(F.exists(F.map_entries("props"), lambda e: e.key.startswith("aria-") & (F.btrim(e.value) == "")), F.lit(False)), "aria-empty-value", "warning"),
    )
    rows = found.select("path", "node_id", "tag", "line", F.explode(F.array_compact(rules)).alias("r"))
    return rows.select("path", "node_id", "tag", "line", "r.rule", "r.severity")


#: Points that a violation costs, and rules that belong to level AA (fixed values).
PENALTIES = {"error": 10, "warning": 5, "info": 1}
LEVEL_AA = ("link-text-descriptive", "heading-hierarchy-start", "heading-hierarchy-skip")


def compliance(errors: Column, a_errors: Column, aa_warnings: Column) -> Column:
    """The level that violations leave: AAA without errors and warnings on AA rules, AA without errors, A without errors on A rules."""
    return F.when((errors == 0) & (aa_warnings == 0), "AAA").when(errors == 0, "AA").when(a_errors == 0, "A").otherwise("none")


def accessibility_scores(found: DataFrame, violations: DataFrame) -> DataFrame:
    """path, elements, violations, score, level: the share of elements without a violation, less twice the penalties (fifty at most)."""
    n = found.groupBy("path").agg(F.count(F.lit(1)).alias("elements"))
    cost = sum((F.when(F.col("severity") == s, w).otherwise(0) for s, w in PENALTIES.items()), F.lit(0))
    error, aa = F.col("severity") == "error", F.col("rule").isin(*LEVEL_AA)
    v = violations.groupBy("path").agg(
        F.count(F.lit(1)).alias("violations"), F.countDistinct("node_id").alias("hit"), F.sum(cost).alias("cost"), F.count_if(error).alias("errors"), F.count_if(error & ~aa).alias("a_errors"), F.count_if((F.col("severity") == "warning") & aa).alias("aa_warnings"),
    )
    rows = n.join(v, "path", "left").fillna(0)
    score = F.greatest(F.lit(0), F.floor((F.col("elements") - F.col("hit")) / F.col("elements") * 100 - F.least(2 * F.col("cost"), F.lit(50)) + 0.5))
    return rows.select("path", "elements", "violations", score.cast("long").alias("score"), compliance(F.col("errors"), F.col("a_errors"), F.col("aa_warnings")).alias("level"))


def duplicate_ids(found: DataFrame) -> DataFrame:
    own = found.select("path", "node_id", F.col("props")["id"].alias("id")).where("id is not null and id not like '{%'")
    return own.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("path", "id"))).where("n > 1").drop("n")


def heading_skips(found: DataFrame) -> DataFrame:
    h = found.where(F.col("tag").rlike("^h[1-6]$")).select("path", "node_id", F.substring("tag", 2, 1).cast("int").alias("level"))
    h = h.withColumn("before", F.lag("level").over(W.partitionBy("path").orderBy("node_id")))
    first = F.col("before").isNull()
    return h.where((first & (F.col("level") != 1)) | (F.col("level") > F.col("before") + 1)).select("path", "node_id", "level", F.when(first, "heading-hierarchy-start").otherwise("heading-hierarchy-skip").alias("rule"))


def type_definitions(nodes: DataFrame) -> DataFrame:
    """path, name, kind, extends, properties, methods, signature: a signature is the same for types of the same shape."""
    own = nodes.where("kind in ('Interface', 'TypeAlias', 'Enum', 'Class')").select("path", "node_id", "name", "kind", F.coalesce("text", F.lit("")).alias("head"), "line")
    members = nodes.where("kind in ('Property', 'Method', 'EnumMember')").select("path", F.col("parent_id").alias("node_id"), F.col("kind").alias("member"), F.col("name").alias("m"), F.coalesce("text", F.lit("")).alias("t"))
    shape = members.groupBy("path", "node_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("member") != "Method", F.concat_ws(":", "m", "t")))).alias("properties"),
        F.sort_array(F.collect_list(F.when(F.col("member") == "Method", F.concat_ws(":", "m", "t")))).alias("methods"),
    )
    none = F.array().cast("array<string>")
    out = own.join(shape, ["path", "node_id"], "left").withColumns({"properties": F.coalesce("properties", none), "methods": F.coalesce("methods", none)})
    body = F.when(F.size("properties") + F.size("methods") > 0, F.concat_ws(";", F.array_join("properties", ","), F.array_join("methods", ","))).otherwise(F.regexp_replace("head", r"\s+", ""))
    return out.withColumn("signature", F.sha2(F.concat_ws("|", "kind", body), 256))


def duplicate_types(types: DataFrame) -> DataFrame:
    """signature, n, names, paths of shapes that are defined more than once."""
    groups = types.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("name")).alias("names"), F.sort_array(F.collect_set("path")).alias("paths"))
    return groups.where("n > 1")


#: Numbers that need no name (fixed values).
PLAIN_NUMBERS = ("0", "1", "2", "-1", "10", "100", "1000", "24", "60", "0.5")


def magic_numbers(nodes: DataFrame) -> DataFrame:
    """path, line, col, text: number literals that aren't plain, named by a constant, members of an enum or an index, or part of markup."""
    numbers = nodes.where("kind = 'Number'").where(~F.col("text").isin(*PLAIN_NUMBERS))
    parents = nodes.select("path", F.col("node_id").alias("parent_id"), F.col("kind").alias("pk"), F.col("name").alias("pn"), F.col("text").alias("pt"))
    fine = F.col("pk").isin("Enum", "Index", "Array", "Template") | ((F.col("pk") == "Variable") & F.col("pt").startswith("const")) | ((F.col("pk") == "Property") & F.col("pn").isNotNull()) | (F.col("pk") == "Parameter")
    port = F.col("text").cast("int").between(3000, 9999)
    return numbers.join(parents, ["path", "parent_id"], "left").where(~F.coalesce(fine, F.lit(False)) & ~F.coalesce(port, F.lit(False))).select("path", "line", "col", "text")


def translation_keys(nodes: DataFrame) -> DataFrame:
    """path, namespace, key, line: calls of the variable that a translation hook gave, with the hook's namespace."""
    hooks = nodes.where("kind = 'Call' and name rlike '^useTranslations?$'").select("path", F.col("node_id").alias("hook"), F.col("parent_id"))
    spaces = nodes.where("kind = 'String'").select("path", F.col("parent_id").alias("hook"), F.regexp_replace("text", "^['\"]|['\"]$", "").alias("namespace"))
    holders = nodes.where("kind = 'Variable'").select("path", F.col("node_id").alias("parent_id"), F.regexp_extract("name", r"([A-Za-z_$][\w$]*)", 1).alias("var"))
    named = hooks.join(holders, ["path", "parent_id"]).join(spaces, ["path", "hook"], "left").select("path", "var", F.coalesce("namespace", F.lit("")).alias("namespace"))
    calls = nodes.where("kind = 'Call'").select("path", F.col("node_id").alias("call"), F.col("name").alias("var"), "line")
    texts = nodes.where("kind = 'String'").select("path", F.col("parent_id").alias("call"), F.regexp_replace("text", "^['\"]|['\"]$", "").alias("key"))
    rows = calls.join(named, ["path", "var"]).join(texts, ["path", "call"])
    return rows.select("path", "namespace", "key", F.concat_ws(".", F.when(F.col("namespace") != "", F.col("namespace")), "key").alias("full_key"), "line")
