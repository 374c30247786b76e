"""Dependency graphs: parts that follow each other in an order, orders that follow each other for a customer, kinds of events that follow
each other for a user. All rows of the tables are in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.text import round_half_up
from quarry.operators import graph as G
from quarry.operators import modules as M
from quarry.plans.common import table
from quarry.plans.pages import _LINK_NORMAL, _LINKS, _NORMAL, _PATH
from quarry.registry import query
from quarry.sources import pages as H

#: The edges as SQL: consecutive lines of an order.
_EDGES = """edges AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
    FROM lineitem) WHERE src <> dst)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    follow = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return G.dependency_graph(lines.select(F.col("l_partkey").alias("src"), follow.alias("dst")))


@query("dependency_edges", f"WITH {_EDGES} SELECT src, dst FROM edges")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query("fan_in_out", f"WITH {_EDGES} SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node")
def fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_edges(spark, sf_dir))


#: Orders of a customer in order of date: each leads to the next. Ranks say what the graph operators should find.
_CHAINS = "chain AS (SELECT o_orderkey AS node, o_custkey, row_number() OVER w AS turn, count(*) OVER (PARTITION BY o_custkey) AS n, first_value(o_orderkey) OVER w AS head FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    follow = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return G.dependency_graph(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), follow.alias("dst")))


@query("entry_points", f"WITH {_CHAINS} SELECT node FROM chain WHERE turn = 1 AND n > 1")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.entry_points(_chains(spark, sf_dir))


@query("isolated_nodes", "SELECT doc_id AS node FROM documents WHERE text IS NULL OR text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)")
def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a link to a copy; copies are linked with the first of them, by a digest of their text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), F.sha2("text", 256).alias("print"))
    first = docs.groupBy("print").agg(F.min("node").alias("dst"))
    copies = docs.join(first, "print").select(F.col("node").alias("src"), "dst")
    return G.isolated(docs.select("node"), G.dependency_graph(copies))


@query("reachable", f"WITH {_CHAINS} SELECT node, (turn - 1)::INT AS depth FROM chain WHERE n > 1")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = G.checkpointed(_chains(spark, sf_dir))
    return G.reachable(edges, G.entry_points(edges))


@query("connected_components", f"WITH {_CHAINS} SELECT node, min(node) OVER (PARTITION BY o_custkey) AS \"group\" FROM chain WHERE n > 1")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(_chains(spark, sf_dir))


@query("transitive_dependencies", f"WITH {_CHAINS} SELECT a.node AS src, b.node AS dst, (b.turn - a.turn)::INT AS depth FROM chain a JOIN chain b ON a.o_custkey = b.o_custkey AND b.turn > a.turn AND b.turn <= a.turn + 3")
def transitive_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.within(_chains(spark, sf_dir), 3)


#: Which kind of event follows which, for each user: five nodes a user, with rings in most.
_STEPS = """edges AS (SELECT DISTINCT src, dst FROM (SELECT user_id || '/' || event_type AS src, lead(user_id || '/' || event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE src <> dst),
    nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), entry AS (SELECT DISTINCT src AS node FROM edges WHERE src NOT IN (SELECT dst FROM edges))"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("src"))
    follow = F.lead("src").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return G.dependency_graph(named.select("src", follow.alias("dst")))


@query("unreachable_nodes", f"WITH RECURSIVE {_STEPS}, walk AS (SELECT node FROM entry UNION SELECT e.dst FROM walk w JOIN edges e ON e.src = w.node) SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM walk)")
def unreachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.unreachable(G.checkpointed(_steps(spark, sf_dir)))


@query(
    "cycle_groups",
    f"""WITH RECURSIVE {_STEPS}, walk AS (SELECT src, dst FROM edges UNION SELECT w.src, e.dst FROM walk w JOIN edges e ON e.src = w.dst)
    SELECT a.src AS node, min(a.dst) AS "group" FROM walk a JOIN walk b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""",
)
def cycle_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cycle_groups(_steps(spark, sf_dir))


_RINGS = f"""{_STEPS}, walk AS (SELECT [src, dst] AS p FROM edges WHERE src < dst UNION ALL SELECT list_append(p, e.dst) FROM walk JOIN edges e ON e.src = p[-1] WHERE e.dst > p[1] AND NOT list_contains(p, e.dst)),
    ring AS (SELECT p FROM walk JOIN edges e ON e.src = p[-1] AND e.dst = p[1])"""


@query("cycle_paths", f"WITH RECURSIVE {_RINGS} SELECT array_to_string(p, ' > ') AS cycle, len(p)::INT AS size, len(p) > 3 AS critical FROM ring")
def cycle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.cycles(_steps(spark, sf_dir))
    return found.select(F.array_join("cycle", " > ").alias("cycle"), "size", "critical")


@query("cycle_statistics", f"WITH RECURSIVE {_RINGS} SELECT count(*) AS cycles, max(len(p))::INT AS longest, count_if(len(p) > 3) AS critical, (SELECT count(DISTINCT x) FROM (SELECT unnest(p) AS x FROM ring)) AS nodes FROM ring")
def cycle_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cycle_statistics(M.cycles(_steps(spark, sf_dir)))


#: Nodes in ascending order: one starts a cluster if no smaller one that no entry point leads to leads to it; a cluster is all that its start leads to.
_ZOMBIES = f"""{_STEPS}, walk AS (SELECT node FROM entry UNION SELECT e.dst FROM walk w JOIN edges e ON e.src = w.node), gone AS (SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM walk)),
    ahead AS (SELECT node AS start, node FROM gone UNION SELECT a.start, e.dst FROM ahead a JOIN edges e ON e.src = a.node),
    starts AS (SELECT node FROM ahead GROUP BY node HAVING min(start) = node AND node IN (SELECT node FROM gone)),
    z AS (SELECT node, start AS cluster, (count(*) OVER (PARTITION BY start))::INT AS size FROM ahead WHERE start IN (SELECT node FROM starts))"""


@query("zombie_clusters", f"WITH RECURSIVE {_ZOMBIES} SELECT node, cluster, size, CASE WHEN size > 5 THEN 'high' WHEN size > 2 THEN 'medium' ELSE 'low' END AS risk FROM z")
def zombie_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.zombie_clusters(G.checkpointed(_steps(spark, sf_dir)))


@query(
    "ring_lengths",
    f"""WITH RECURSIVE {_STEPS}, walk AS (SELECT src AS origin, dst AS node, 1 AS n FROM edges UNION SELECT w.origin, e.dst, w.n + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.n < 5),
    far AS (SELECT origin, node FROM walk UNION SELECT node, node FROM nodes)
    SELECT w.origin AS node, min(w.n)::INT AS ring, min(w.n) > 3 AS critical, (SELECT min(f.node) FROM far f JOIN far g ON g.origin = f.node AND g.node = f.origin WHERE f.origin = w.origin) AS "group" FROM walk w WHERE w.origin = w.node GROUP BY w.origin""",
)
def ring_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each node in a ring its shortest ring; SQL may stop at five steps, as a user has five kinds of events."""
    return G.ring_lengths(G.checkpointed(_steps(spark, sf_dir))).withColumn("critical", F.col("ring") > 3)


@query("zombie_statistics", f"WITH RECURSIVE {_ZOMBIES} SELECT count(DISTINCT cluster) AS clusters, count(*) AS nodes, coalesce(max(size), 0)::INT AS largest, coalesce(count(*) / nullif(count(DISTINCT cluster), 0), 0)::DOUBLE AS mean_size, (SELECT count(*) FROM entry) AS entries FROM z")
def zombie_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = G.checkpointed(_steps(spark, sf_dir))
    return M.zombie_statistics(M.zombie_clusters(edges), edges)


@query(
    "transition_graph",
    """SELECT src, dst, count(*) AS n FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE src <> dst GROUP BY 1, 2""",
)
def transition_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    follow = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), follow.alias("dst")).where("src <> dst")
    return steps.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(
    "component_statistics",
    f"""WITH {_EDGES}, d AS (SELECT node, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node)
    SELECT count(*) AS nodes, sum(fan_out)::BIGINT AS edges, max(fan_in)::BIGINT AS most_in, max(fan_out)::BIGINT AS most_out, count_if(fan_in > 5) AS hubs, floor(sum(fan_out) * 100.0 / count(*) + 0.5) / 100 AS average_out FROM d""",
)
def component_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_edges(spark, sf_dir)).agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("fan_out").alias("edges"), F.max("fan_in").alias("most_in"), F.max("fan_out").alias("most_out"),
        F.count_if(F.col("fan_in") > 5).alias("hubs"), round_half_up(F.try_divide(F.sum("fan_out"), F.count(F.lit(1))), 2).alias("average_out"),
    )


#: Pages of a host: the host leads to each page, a page to what it links to on its host. Hosts are hubs, pages branch, what several link to merges.
_SITE = f"""host AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, {_PATH} AS path FROM pages), link AS (SELECT page_id, {_NORMAL} AS target FROM (SELECT page_id, {_LINK_NORMAL} AS x FROM ({_LINKS}) WHERE href LIKE '/%')),
    edges AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, host || path AS dst FROM host UNION ALL SELECT host || path, host || target FROM host JOIN link USING (page_id)) WHERE src <> dst)"""


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    host = pages.select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), P.url_path(F.col("url")).alias("path"))
    down = host.select(F.col("host").alias("src"), F.concat("host", "path").alias("dst"))
    links = H.links(pages).where(F.col("href").startswith("/")).select("page_id", P.normal_link(F.col("href")).alias("target"))
    across = host.join(links, "page_id").select(F.concat("host", "path").alias("src"), F.concat("host", "target").alias("dst"))
    return G.checkpointed(G.dependency_graph(down.union(across)))


_SITE_WALK = f"{_SITE}, entry AS (SELECT DISTINCT src AS node FROM edges WHERE src NOT IN (SELECT dst FROM edges)), walk AS (SELECT node, 0 AS depth FROM entry UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 8)"


@query("site_edges", f"WITH {_SITE} SELECT src, dst FROM edges")
def site_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _site(spark, sf_dir)


@query("site_depths", f"WITH RECURSIVE {_SITE_WALK} SELECT node, min(depth)::INT AS depth FROM walk GROUP BY 1")
def site_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many clicks each page is away from its host."""
    edges = _site(spark, sf_dir)
    return G.reachable(edges, G.entry_points(edges))


@query("site_components", f"""WITH RECURSIVE {_SITE}, both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), walk AS (SELECT src AS node, src AS other FROM both_ UNION SELECT w.node, b.dst FROM walk w JOIN both_ b ON b.src = w.other) SELECT node, min(other) AS "group" FROM walk GROUP BY 1""")
def site_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(_site(spark, sf_dir))


@query("site_within_two", f"WITH {_SITE}, two AS (SELECT src, dst, 1 AS depth FROM edges UNION ALL SELECT a.src, b.dst, 2 FROM edges a JOIN edges b ON b.src = a.dst) SELECT src, dst, min(depth)::INT AS depth FROM two WHERE src <> dst GROUP BY 1, 2")
def site_within_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.within(_site(spark, sf_dir), 2)
