"""Modules: which file, component or package an import means, and what follows from that: usage, graphs by file, flow from routes.

Inputs are rows: files(path), imports(path, specifier, ...), components(path, name, ...). Lookups are equi-joins on keys that are
exploded once from the looked-up side; where several keys fit, the first of a stated order wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.text import round_half_up
from quarry.operators import code as C
from quarry.operators import graph as G

#: How an import that means a file of the project starts, ends or what it holds (fixed values).
INTERNAL_STARTS = ("./", "../", "@/", "/", "app/", "pages/", "components/", "lib/", "utils/", "hooks/", "types/", "src/", "styles/")
INTERNAL_ENDS = (".css", ".scss", ".sass", ".less", ".module.css")
INTERNAL_PARTS = (".types", ".schema", "\\")
PACKAGE = r"(?i)^(@[^/]+/[^/]+.*|[a-z0-9][a-z0-9_-]*(/.*)?)$"
#: Elements of pages, and what the framework itself brings (fixed values).
HTML = (
    "a abbr address area article aside audio b base blockquote body br button canvas caption code col colgroup data datalist dd del details dfn dialog div dl dt em embed fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta nav noscript object ol optgroup option "
    "output p picture pre progress q s samp script section select small source span strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track "
    "u ul var video"
).split()
BUILT_IN = ("Fragment", "React.Fragment", "Suspense", "React.Suspense", "StrictMode", "React.StrictMode", "Profiler", "React.Profiler")


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(js|jsx|ts|tsx)$", "")


def joined(folder: Column, relative: Column) -> Column:
    """A relative path seen from a folder, with . and .. folded; steps above the root are dropped."""
    steps = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda x: ~x.isin("", "."))
    none = F.array().cast("array<string>")
    folded = F.aggregate(steps, none, lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x))))
    return F.array_join(folded, "/")


def meant(importer: Column, specifier: Column) -> Column:
    """The path below the root that an import names, without its extension: relative ones from the importer's folder, / and @/ from the root."""
    path = F.when(specifier.startswith("."), joined(P.dirname(importer), specifier)).otherwise(joined(F.lit(""), F.regexp_replace(specifier, "^(@/|~/|/)", "")))
    return without_extension(path)


def path_keys(path: Column) -> Column:
    """What an import may call a file: its path without extension, without /index, and both below src/."""
    bare = without_extension(path)
    folder = F.regexp_replace(bare, r"(^|/)index$", "")
    below = lambda x: F.regexp_replace(x, "^src/", "")
    return F.filter(F.array_distinct(F.array(bare, folder, below(bare), below(folder))), lambda x: x != "")


def _first(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("_turn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_turn = 1").drop("_turn")


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """All columns of imports(path, specifier, ...), and target (the file that is meant, null if none), external and package."""
    keys = files.select(F.col("path").alias("target"), F.posexplode(path_keys(F.col("path"))).alias("rank", "key"))
    # A key may be two files' (a.ts and a.tsx, a.ts and a/index.ts): the more direct one, then the first by name.
    index = _first(keys, ["key"], "rank", "target").select("key", "target")
    s = F.col("specifier")
    named = imports.withColumn("key", meant(F.col("path"), s)).join(index, "key", "left").drop("key")
    inside = reduce(lambda a, x: a | s.startswith(x), INTERNAL_STARTS, F.lit(False)) | reduce(lambda a, x: a | s.endswith(x), INTERNAL_ENDS, F.lit(False))
    inside = inside | reduce(lambda a, x: a | s.contains(x), INTERNAL_PARTS, F.lit(False))
    external = ~inside & F.col("target").isNull() & s.rlike(PACKAGE)
    return named.withColumns({"external": external, "package": F.when(external, P.package_name(s))})


def component_keys(components: DataFrame) -> DataFrame:
    """key, path, name: every name that an import may use for a component: its own, its file's, and its path in four forms."""
    path = F.col("path")
    bare = without_extension(path)
    keys = F.array_distinct(F.array("name", P.stem(path), bare, path, F.concat_ws("/", P.dirname(path), P.stem(path))))
    return components.select(F.explode(F.filter(keys, lambda k: k != "")).alias("key"), "path", "name").distinct()


def looked_up(imports: DataFrame, components: DataFrame) -> DataFrame:
    """path, specifier, target, name: all components that an import's normalised text names (no ./ or / at the start, no extension)."""
    key = F.regexp_replace(F.regexp_replace(without_extension(F.col("specifier")), r"^\./", ""), "^/", "")
    keys = component_keys(components).select("key", F.col("path").alias("target"), "name")
    return imports.select("path", "specifier", key.alias("key")).distinct().join(keys, "key").select("path", "specifier", "target", "name")


def found_by_name(imports: DataFrame, components: DataFrame) -> DataFrame:
    """path, specifier, target, name, way: an import's components by the last part of its path: one of that name, else those of the
    first file of that name, else (relative imports) those whose path holds it, else those that export it.

    components has (path, name, exports)."""
    base = F.regexp_replace(P.basename(F.col("specifier")), r"(.)\.[^.]*$", "$1")
    wanted = imports.select("path", "specifier", base.alias("base")).distinct()
    known = components.select(F.col("path").alias("target"), "name", "exports")
    direct = _first(known.select(F.col("name").alias("base"), "target", "name"), ["base"], "target").withColumn("way", F.lit(1))
    stems = known.withColumn("base", P.stem(F.col("target")))
    one_file = _first(stems.select("base", "target").distinct(), ["base"], "target")
    by_file = stems.join(one_file, ["base", "target"]).select("base", "target", "name").withColumn("way", F.lit(2))
    # A part of a path that holds a whole folder or file name; the reference's substring test has no key to join on.
    parts = known.select(F.explode(F.array_distinct(F.flatten(F.transform(F.split("target", "/"), lambda x: F.array(x, F.regexp_replace(x, r"(.)\.[^.]*$", "$1")))))).alias("base"), "target", "name")
    by_part = parts.withColumn("way", F.lit(3))
    by_export = known.select(F.explode("exports").alias("base"), "target", "name").withColumn("way", F.lit(4))
    met = wanted.join(direct.union(by_file.select(direct.columns)).union(by_part.select(direct.columns)).union(by_export.select(direct.columns)), "base")
    met = met.where((F.col("way") != 3) | F.col("specifier").startswith("."))
    best = met.withColumn("least", F.min("way").over(W.partitionBy("path", "specifier")))
    return best.where("way = least").select("path", "specifier", "target", "name", "way").distinct()


def bound_names(nodes: DataFrame) -> DataFrame:
    """path, specifier, local, imported, is_type, line: a row for each name that an import binds."""
    own = nodes.where("kind = 'Import'").select("path", F.col("node_id").alias("parent_id"), F.col("name").alias("specifier"), "line")
    typed = nodes.where("kind = 'TypeOnly'").select("path", "parent_id", F.lit(True).alias("is_type"))
    names = nodes.where("kind = 'ImportName'").select("path", "parent_id", F.col("name").alias("local"), F.col("text").alias("imported"))
    rows = own.join(names, ["path", "parent_id"]).join(typed, ["path", "parent_id"], "left")
    return rows.select("path", "specifier", "local", "imported", F.coalesce("is_type", F.lit(False)).alias("is_type"), "line")


def references(nodes: DataFrame) -> DataFrame:
    """path, src, src_id, tag, line, in_choice: a tag inside of a component (the outermost function with a capital that holds it), and
    whether a choice decides on it."""
    tags = nodes.where("kind = 'JsxElement' and name rlike '^[A-Z]'").select("path", F.col("node_id").alias("at"), F.col("name").alias("tag"), "line")
    outer = C.functions(nodes).where(F.col("name").rlike("^[A-Z]")).select(F.col("path").alias("p"), F.col("node_id").alias("src_id"), "exit", F.col("name").alias("src"))
    # Nesting is a range inside of one file.
    inside = tags.join(outer, (F.col("path") == F.col("p")) & (F.col("at") > F.col("src_id")) & (F.col("at") <= F.col("exit")))
    rows = _first(inside, ["path", "at"], "src_id").drop("p", "exit")
    choices = nodes.where("kind in ('Conditional', 'Logical', 'If', 'Switch')").select(F.col("path").alias("q"), F.col("node_id").alias("choice"), F.col("parent_id").alias("holder"), F.col("exit").alias("until"), F.col("kind").alias("k"))
    parents = nodes.select(F.col("path").alias("q"), F.col("node_id").alias("holder"), F.col("exit").alias("holder_exit"))
    # An && decides on what follows it in the expression that holds it.
    spans = choices.join(parents, ["q", "holder"], "left").select("q", "choice", F.when(F.col("k") == "Logical", F.col("holder_exit")).otherwise(F.col("until")).alias("until"))
    decided = rows.join(spans, (F.col("path") == F.col("q")) & (F.col("at") > F.col("choice")) & (F.col("at") <= F.col("until")) & (F.col("choice") > F.col("src_id")), "left_semi").select("path", "at", F.lit(True).alias("in_choice"))
    return rows.join(decided, ["path", "at"], "left").withColumn("in_choice", F.coalesce("in_choice", F.lit(False)))


def component_edges(uses: DataFrame, names: DataFrame, components: DataFrame, defaults: DataFrame, files: DataFrame) -> DataFrame:
    """src_path, src, dst_path, dst, external, in_choice: which component a tag means. An import of the tag's name decides first: a file's
    component of that name, or of the imported one, or its default; what can't be found there is external. Without an import it is a
    component of the same file, then the only one of that name anywhere. Tags of no component make no edge.

    uses(path, src, tag, in_choice), names(path, specifier, local, imported), components(path, name), defaults(path, name)."""
    tag = F.substring_index("tag", ".", 1)
    used = uses.where(~F.col("tag").isin(*BUILT_IN)).select(F.col("path").alias("src_path"), "src", "tag", tag.alias("local"), "in_choice")
    used = used.groupBy("src_path", "src", "tag", "local").agg(F.min("in_choice").alias("in_choice"))
    bound = resolved(names, files).select(F.col("path").alias("src_path"), "local", "imported", "specifier", "target", "external")
    bound = _first(bound, ["src_path", "local"], "specifier")
    rows = used.join(bound, ["src_path", "local"], "left")
    own = components.select("path", "name").distinct()
    there = own.select(F.col("path").alias("target"), F.col("name").alias("wanted"), F.col("name").alias("hit"))
    default = _first(defaults.select(F.col("path").alias("target"), F.col("name").alias("default_name")), ["target"], "default_name")
    wanted = F.when(F.col("imported").isin("default", "*") | F.col("imported").isNull(), F.col("tag")).otherwise(F.col("imported"))
    rows = rows.withColumn("wanted", wanted).join(there, ["target", "wanted"], "left").join(default, "target", "left")
    here = own.select(F.col("path").alias("src_path"), F.col("name").alias("tag"), F.lit(True).alias("here"))
    single = own.groupBy(F.col("name").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("only")).where("n = 1").drop("n")
    rows = rows.join(here, ["src_path", "tag"], "left").join(single, "tag", "left")
    imported = F.col("specifier").isNotNull()
    by_default = (F.col("imported") == "default") & F.col("target").isNotNull()
    found = F.col("hit").isNotNull() | (by_default & F.col("default_name").isNotNull())
    name = F.when(imported, F.coalesce("hit", F.when(by_default, F.col("default_name")), F.col("tag"))).otherwise(F.col("tag"))
    path = F.when(imported & found, F.col("target")).when(imported, F.lit(None)).when(F.col("here"), F.col("src_path")).otherwise(F.col("only"))
    out = rows.select("src_path", "src", path.alias("dst_path"), name.alias("dst"), (imported & ~found).alias("external"), "in_choice")
    return out.where("(dst_path is not null or external) and not (src_path <=> dst_path and src = dst)").distinct()


def default_exports(nodes: DataFrame) -> DataFrame:
    return C.exports(nodes).where("is_default").select("path", "name")


def project_edges(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """component_edges over a project's syntax."""
    return component_edges(references(nodes), bound_names(nodes), C.components(nodes), default_exports(nodes), files)


def component_id(path: Column, name: Column) -> Column:
    return F.concat_ws("#", path, name)


def file_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst: files that import files."""
    found = resolved(imports, files).where("target is not null")
    return G.dependency_graph(found.select(F.col("path").alias("src"), F.col("target").alias("dst")))


def circular_files(edges: DataFrame) -> DataFrame:
    """node, group: files that import each other in a ring (strongly connected groups of two and more)."""
    return G.cycle_groups(edges)


def external_packages(imports: DataFrame, files: DataFrame) -> DataFrame:
    """package, n_files, names: packages in use, by how many files."""
    found = resolved(imports, files).where("external")
    return found.groupBy("package").agg(F.countDistinct("path").alias("n_files"), F.sort_array(F.collect_set("local")).alias("names"))


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """cycle (nodes from the smallest on, in order), size, critical (more than three): all simple rings, or those of at most ``longest``
    nodes where a reader wants the short ones. There may be exponentially many in a dense group; ``graph.ring_lengths`` tells which
    nodes lie in rings, and how short ones, without listing any.

    Paths grow from the ring's smallest node through larger ones alone, inside of strongly connected groups, so each ring is found once."""
    groups = G.checkpointed(G.cycle_groups(edges))
    a, b = groups.select(F.col("node").alias("src"), F.col("group").alias("ga")), groups.select(F.col("node").alias("dst"), F.col("group").alias("gb"))
    core = G.checkpointed(edges.join(a, "src").join(b, "dst").where("ga = gb").select("src", "dst"))
    paths = G.checkpointed(core.where("src < dst").select(F.array("src", "dst").alias("path")))
    step = core.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    found, size = None, 1
    while longest is None or size < longest:
        size += 1
        grown = paths.withColumn("at", F.element_at("path", -1)).join(step, "at")
        closed = G.checkpointed(grown.where(F.col("next") == F.get("path", F.lit(0))).select("path"))
        if found is None:
            found = G.Met(closed)
        else:
            found.add(closed)
        longer = G.checkpointed(grown.where((F.col("next") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("next"))).select(F.concat("path", F.array("next")).alias("path")))
        G.discard(paths)
        paths = longer
        if paths.isEmpty():
            break
    rows = paths.limit(0) if found is None else found.rows
    return rows.select(F.col("path").alias("cycle"), F.size("path").alias("size"), (F.size("path") > 3).alias("critical"))


def cycle_statistics(found: DataFrame) -> DataFrame:
    """One row: rings, nodes in them, the longest, those of more than three."""
    nodes = found.select(F.explode("cycle").alias("node")).agg(F.countDistinct("node").alias("nodes"))
    rings = found.agg(F.count(F.lit(1)).alias("cycles"), F.coalesce(F.max("size"), F.lit(0)).alias("longest"), F.count_if("critical").alias("critical"))
    return rings.join(F.broadcast(nodes))  # one row each


def zombie_clusters(edges: DataFrame) -> DataFrame:
    """node, cluster, size, risk: what no entry point leads to, in clusters named by the node that each is walked from.

    Nodes come in ascending order: the first that no entry point leads to and no earlier cluster holds starts a cluster of all that it
    leads to. Its members may be in other clusters too, and may be reached from an entry point. A node starts one exactly if no smaller one of
    its kind leads to it, which carrying the smallest name along the edges tells for all at once."""
    gone = G.checkpointed(G.unreachable(edges))
    inside = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_semi").join(gone.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    colors = G.spread(G.checkpointed(inside), gone.select("node", F.col("node").alias("color")))
    starts = colors.where("node = color").select(F.col("node").alias("cluster"), "node")
    met = G.walk(edges, starts).select("node", "cluster")
    sizes = met.groupBy("cluster").agg(F.count(F.lit(1)).cast("int").alias("size"))
    return met.join(sizes, "cluster").select("node", "cluster", "size", F.when(F.col("size") > 5, "high").when(F.col("size") > 2, "medium").otherwise("low").alias("risk"))


def zombie_statistics(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: clusters, their sizes added up, the largest, the mean size, entry points."""
    c = clusters.agg(
        F.countDistinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("nodes"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"),
        F.coalesce(F.try_divide(F.count(F.lit(1)), F.countDistinct("cluster")), F.lit(0.0)).alias("mean_size"),
    )
    return c.join(F.broadcast(G.entry_points(edges).agg(F.count(F.lit(1)).alias("entries"))))


def call_graph(nodes: DataFrame) -> DataFrame:
    """src, dst as path#function: calls of functions that the same file defines."""
    own = C.functions(nodes).where("name <> 'anonymous'").select("path", F.col("node_id").alias("owner"), "name")
    calls = nodes.where("kind = 'Call'").select("path", "owner", F.col("name").alias("callee"))
    made = calls.join(own.select("path", "owner", F.col("name").alias("caller")), ["path", "owner"])
    known = own.select("path", F.col("name").alias("callee")).distinct()
    both = made.join(known, ["path", "callee"])
    return G.dependency_graph(both.select(component_id(F.col("path"), F.col("caller")).alias("src"), component_id(F.col("path"), F.col("callee")).alias("dst")))


def flow(routes: DataFrame, edges: DataFrame, deepest: int = 10) -> DataFrame:
    """route, path, name, external, in_choice, depth, parent: what the page of a route leads to, each component once, where it is met first.

    routes(route, path, name): a page's component; edges as component_edges gives them. A level is a join with the edges; what a route
    has already met is not expanded again, so rings end, and so does depth."""
    start = routes.select("route", "path", "name", F.lit(False).alias("external"), F.lit(False).alias("in_choice"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))
    seen = frontier = G.checkpointed(start)
    inner = edges.select(F.col("src_path").alias("path"), F.col("src").alias("name"), F.col("dst_path"), F.col("dst"), F.col("external").alias("out"), F.col("in_choice").alias("chosen"))
    for depth in range(1, deepest):
        step = frontier.where("not external").select("route", "path", "name").join(inner, ["path", "name"])
        step = step.select("route", F.col("dst_path").alias("path"), F.col("dst").alias("name"), F.col("out").alias("external"), F.col("chosen").alias("in_choice"), F.lit(depth).alias("depth"), component_id(F.col("path"), F.col("name")).alias("parent"))
        step = _first(step, ["route", "path", "name"], "parent")
        known = seen.select(F.col("route").alias("r"), F.col("path").alias("p"), F.col("name").alias("n"))
        new = step.join(known, (F.col("route") == F.col("r")) & F.col("path").eqNullSafe(F.col("p")) & (F.col("name") == F.col("n")), "left_anti")
        frontier = G.checkpointed(new)
        if frontier.isEmpty():
            break
        seen = G.checkpointed(seen.union(frontier))
    return seen


def flow_statistics(found: DataFrame, conditionals: DataFrame) -> DataFrame:
    """A row a route: components, external and internal ones, depth, conditional renders (conditionals(path, name, n)), and hints on
    how to draw the tree."""
    rows = found.join(conditionals, ["path", "name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per = rows.groupBy("route").agg(
        F.count(F.lit(1)).alias("components"), F.count_if("external").alias("external"), F.count_if(~F.col("external")).alias("internal"), F.max("depth").alias("depth"), F.sum("n").alias("conditionals"),
    )
    deep, wide = F.col("depth") > 5, F.col("conditionals") > 10
    layout = F.when(deep | wide, "force").when(F.col("components") < 10, "circular").otherwise("hierarchical")
    return per.withColumns({"layout": layout, "direction": F.when(deep, "horizontal").otherwise("vertical"), "weight": F.col("components") + 2 * F.col("conditionals")})


def flow_summary(found: DataFrame, statistics: DataFrame, conditionals: DataFrame) -> DataFrame:
    """One row: routes, components met by any of them, conditional renders, the mean of depths at the first meeting (over routes), and the
    route that weighs most (the first by name of equals)."""
    first = _first(found, ["path", "name"], "route", "depth").join(conditionals, ["path", "name"], "left")
    per = first.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.sum("n"), F.lit(0)).alias("conditionals"), F.sum("depth").alias("depths"))
    routes = statistics.agg(F.count(F.lit(1)).alias("routes"), F.min_by("route", F.struct((-F.col("weight")).alias("w"), "route")).alias("most_complex"))
    both = routes.join(F.broadcast(per))
    return both.select("routes", "components", "conditionals", round_half_up(F.try_divide(F.col("depths"), F.col("routes")), 2).alias("average_depth"), "most_complex")


def conditional_renders(nodes: DataFrame) -> DataFrame:
    """path, name, kind, line, col: choices in a component that decide on markup: ternary, logical_and, if, switch.

    && counts if markup follows it in its expression; || counts as logical_and; if and switch count if they hold markup."""
    outer = C.functions(nodes).where(F.col("name").rlike("^[A-Z]")).select(F.col("path").alias("p"), F.col("node_id").alias("f"), F.col("exit").alias("f_exit"), "name")
    parents = nodes.select("path", F.col("node_id").alias("parent_id"), F.col("exit").alias("parent_exit"))
    choice = nodes.where("kind in ('Conditional', 'Logical', 'If', 'Switch')").select("path", "node_id", "parent_id", "exit", F.col("kind").alias("k"), "line", "col").join(parents, ["path", "parent_id"], "left")
    until = F.when(F.col("k") == "Logical", F.col("parent_exit")).otherwise(F.col("exit"))
    marks = nodes.where("kind = 'JsxElement'").select(F.col("path").alias("q"), F.col("node_id").alias("mark"))
    with_marks = choice.join(marks, (F.col("path") == F.col("q")) & (F.col("mark") > F.col("node_id")) & (F.col("mark") <= until), "left_semi")
    inside = with_marks.join(outer, (F.col("path") == F.col("p")) & (F.col("node_id") > F.col("f")) & (F.col("node_id") <= F.col("f_exit")))
    rows = _first(inside, ["path", "node_id"], "f")
    kind = F.when(F.col("k") == "Conditional", "ternary").when(F.col("k") == "Logical", "logical_and").when(F.col("k") == "If", "if").otherwise("switch")
    return rows.select("path", "name", kind.alias("kind"), "line", "col")


def returned_markup(nodes: DataFrame) -> DataFrame:
    """path, name, n_returns, early, implicit, in_switch: how a component hands out its markup."""
    own = C.functions(nodes).where(F.col("name").rlike("^[A-Z]")).select("path", F.col("node_id").alias("owner"), "name", "flavour")
    returns = nodes.where("kind = 'Return'").select("path", "owner", "node_id", F.col("exit").alias("until"), "nesting", "parent_id")
    marks = nodes.where("kind = 'JsxElement'").select(F.col("path").alias("q"), F.col("node_id").alias("mark"), F.col("owner").alias("o"))
    held = returns.join(marks, (F.col("path") == F.col("q")) & (F.col("owner") == F.col("o")) & (F.col("mark") > F.col("node_id")) & (F.col("mark") <= F.col("until")), "left_semi")
    cases = nodes.where("kind in ('Case', 'Default')").select("path", F.col("node_id").alias("parent_id"), F.lit(True).alias("case"))
    rows = held.join(cases, ["path", "parent_id"], "left").join(own, ["path", "owner"])
    bodies = nodes.where("kind = 'Return'").groupBy("path", "owner").agg(F.count(F.lit(1)).alias("all"))
    per = rows.groupBy("path", "owner", "name", "flavour").agg(F.count(F.lit(1)).alias("n_returns"), F.count_if(F.col("nesting") > 0).alias("early"), F.coalesce(F.max("case"), F.lit(False)).alias("in_switch")).join(bodies, ["path", "owner"])
    implicit = F.col("flavour").contains("arrow") & (F.col("all") == 1) & (F.col("early") == 0)
    return per.select("path", "name", "n_returns", "early", implicit.alias("single_arrow"), "in_switch")


def pages_using(edges: DataFrame, routes: DataFrame) -> DataFrame:
    """path, name, pages: for each component the pages that use it directly."""
    starts = routes.select(F.col("path").alias("src_path"), F.col("name").alias("src"), "route")
    met = edges.where("not external").join(starts, ["src_path", "src"])
    return met.groupBy(F.col("dst_path").alias("path"), F.col("dst").alias("name")).agg(F.sort_array(F.collect_set("route")).alias("pages"))


def tracked_elements(nodes: DataFrame, only: tuple[str, ...] = (), leave_out: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """path, tag, n: page elements by tag; some tags alone, or without some, or only those that hold text."""
    tags = nodes.where("kind = 'JsxElement'").where(F.col("name").isin(*HTML))
    if only:
        tags = tags.where(F.col("name").isin(*only))
    if leave_out:
        tags = tags.where(~F.col("name").isin(*leave_out))
    if with_text:
        text = nodes.where("kind = 'JsxText'").select("path", F.col("parent_id").alias("node_id"))
        tags = tags.join(text, ["path", "node_id"], "left_semi")
    return tags.groupBy("path", F.col("name").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
