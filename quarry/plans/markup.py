"""Trees of all given pages, and what they say. SQL builds the trees by walking tokens in a recursive query, one token of each page a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import markup as K
from quarry.operators.code import LEVEL_AA, PENALTIES, ROLES
from quarry.plans.common import table, values
from quarry.registry import query
from quarry.sources import markup as M

#: Pages with what the given ones lack (fixture), beside them all.
ODD = [
    (-1, "http://odd.example.org/a", '<html lang="english!"><body><h2>a</h2><h4>b</h4><img src="x.png"><img alt="Photo" src=y.png><a href="/x"><b></b></a><a href=\'/y\'><b>More</b></a><button><i></i></button><button aria-label="go"></button></body></html>'),
    (-2, "http://odd.example.org/b", '<html><form><fieldset><input id="q" placeholder="find"><label for="r">R</label><input id="r"></fieldset><fieldset title="t"><label>L <input id="q" placeholder=p></label></fieldset><fieldset><legend>G</legend><input type="hidden"></fieldset></form>'),
    (-3, "http://odd.example.net/c", '<html lang="de-AT"><h1>One</h1><div role="buton" onclick="f()">x</div><div onclick="g()">y</div><p aria-hidden="yes" aria-expanded="maybe">t<p>u<ul><li>1<li>2<ul><li>3</ul></ul><table><tr><td>a<td>b<tr><td>c</table></span>'),
    (-4, "http://odd.example.net/d", "<p>a<!-- <b> -->b < c<br/><textarea><p></textarea><dl><dt>x<dd>y<dt>z</dl><select><option>1<option>2</select>"), (-5, None, None), (-6, "x", ""),
]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html").union(spark.createDataFrame(ODD, "page_id long, url string, html string"))


def _list(names) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]::VARCHAR[]"


def _in(names) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_LAST = "coalesce(list_max(list_transform(tags, lambda x, j: CASE WHEN list_contains({0}, x) THEN j ELSE 0 END)), 0)"
_CLOSES = " ".join(f"WHEN opens AND tag IN {_in(tags)} THEN {_list(ends)}" for tags, ends, _ in M.IMPLIED)
_SHIELDS = " ".join(f"WHEN opens AND tag IN {_in(tags)} THEN {_list(beyond)}" for tags, _, beyond in M.IMPLIED)
#: tree(page_id, url, node_id, parent_id, exit, depth, tag, token): all nodes. Starts a recursive WITH.
_TREE = rf"""source AS (SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM {values(ODD, "page_id, url, html")}),
    cells AS (SELECT page_id, url, regexp_extract_all(coalesce(html, ''), {_sql(M.TOKEN)}) AS toks FROM source),
    tok AS (SELECT page_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS i FROM cells),
    named AS (SELECT *, lower(regexp_extract(token, {_sql(M.TAG)}, 1)) AS tag FROM tok),
    sorted_ AS (SELECT *, CASE WHEN tag = '' AND starts_with(token, '<!') THEN 'note' WHEN tag = '' THEN 'text' WHEN starts_with(token, '</') THEN 'end'
        WHEN tag IN {_in(M.RAW)} AND regexp_matches(token, '(?is)</[a-z]+\s*>$') THEN 'raw' WHEN tag IN {_in(M.VOID)} OR ends_with(token, '/>') THEN 'void' ELSE 'start' END AS kind FROM named),
    ruled AS (SELECT *, kind IN ('start', 'void', 'raw') AS opens FROM sorted_),
    rule AS (SELECT page_id, i, token, tag, kind, CASE WHEN kind = 'end' THEN [tag] {_CLOSES} ELSE []::VARCHAR[] END AS closes, CASE WHEN kind = 'end' THEN []::VARCHAR[] {_SHIELDS} ELSE []::VARCHAR[] END AS shields FROM ruled),
    walk AS (SELECT page_id, -1::BIGINT AS i, []::VARCHAR[] AS tags, []::BIGINT[] AS ids, -1::BIGINT AS parent, 0::BIGINT AS depth, []::BIGINT[] AS closed FROM cells
      UNION ALL SELECT page_id, i, CASE WHEN kind = 'start' THEN list_append(tags[:first - 1], tag) ELSE tags[:first - 1] END, CASE WHEN kind = 'start' THEN list_append(ids[:first - 1], i) ELSE ids[:first - 1] END,
        CASE WHEN first > 1 THEN ids[first - 1] ELSE -1 END, first - 1, ids[first:]
      FROM (SELECT *, CASE WHEN c > s THEN c ELSE len(tags) + 1 END AS first FROM (SELECT r.page_id, r.i, r.tag, r.kind, w.tags, w.ids, {_LAST.format("r.closes")} AS c, {_LAST.format("r.shields")} AS s FROM walk w JOIN rule r ON r.page_id = w.page_id AND r.i = w.i + 1))),
    ended AS (SELECT page_id, unnest(closed) AS node_id, i - 1 AS exit FROM walk),
    ends AS (SELECT page_id, max(i) AS last FROM tok GROUP BY 1),
    tree AS (SELECT r.page_id, c.url, r.i::INT AS node_id, w.parent::INT AS parent_id, (CASE WHEN r.kind = 'start' THEN coalesce(e.exit, ends.last) ELSE r.i END)::INT AS exit, w.depth::INT AS depth, CASE WHEN r.kind = 'text' THEN '#text' ELSE r.tag END AS tag, r.token
      FROM rule r JOIN walk w ON w.page_id = r.page_id AND w.i = r.i JOIN cells c ON c.page_id = r.page_id JOIN ends ON ends.page_id = r.page_id LEFT JOIN ended e ON e.page_id = r.page_id AND e.node_id = r.i
      WHERE r.kind IN ('start', 'void', 'raw') OR (r.kind = 'text' AND regexp_matches(r.token, '[^\s]'))),
    worded AS (SELECT t.page_id, t.node_id, trim(regexp_replace(coalesce(string_agg(x.token, '' ORDER BY x.i), ''), '\s+', ' ', 'g'), ' ') AS text FROM tree t LEFT JOIN rule x ON x.page_id = t.page_id AND x.i > t.node_id AND x.i <= t.exit AND x.kind = 'text'
      WHERE t.tag IN {_in(K.TEXTED)} GROUP BY 1, 2)"""


def _attribute(name: str) -> str:
    found = f"regexp_extract(token, {_sql(M.attribute_pattern(name))}, 1)"
    return f"CASE WHEN {found} <> '' THEN regexp_replace({found}, '^[\"'']|[\"'']$', '', 'g') END"


@query("page_nodes", f"WITH RECURSIVE {_TREE} SELECT page_id, node_id, parent_id, exit, depth, tag FROM tree")
def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of all pages as nested sets."""
    return M.elements(M.trees(_pages(spark, sf_dir))).select("page_id", "node_id", "parent_id", "exit", "depth", "tag")


@query("page_links", f"WITH RECURSIVE {_TREE} SELECT t.page_id, t.node_id, {_attribute('href')} AS href, text AS label FROM tree t JOIN worded USING (page_id, node_id) WHERE tag = 'a'")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with all the text inside of them, also in inner elements."""
    rows = M.elements(M.trees(_pages(spark, sf_dir), texts=False), only=lambda x: x["tag"] == "a", texts=("a",))
    return rows.select("page_id", "node_id", M.attribute(F.col("token"), "href").alias("href"), F.col("text").alias("label"))


#: What holds links, headings and paragraphs (fixed values).
LANDMARKS = ("article", "aside", "footer", "header", "main", "nav", "section")
_HELD = {"links": "tag = 'a'", "headings": "tag rlike '^h[1-6]$'", "paragraphs": "tag = 'p'"}


@query(
    "landmark_contents",
    f"""WITH RECURSIVE {_TREE} SELECT o.page_id, o.node_id, o.tag, count(*) FILTER (i.tag = 'a') AS links, count(*) FILTER (regexp_matches(i.tag, '^h[1-6]$')) AS headings, count(*) FILTER (i.tag = 'p') AS paragraphs
    FROM tree o JOIN tree i ON i.page_id = o.page_id AND i.node_id > o.node_id AND i.node_id <= o.exit WHERE o.tag IN {_in(LANDMARKS)} AND regexp_matches(i.tag, '^(a|p|h[1-6])$') GROUP BY ALL""",
)
def landmark_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies inside of each landmark, by a join of intervals."""
    rows = G.checkpointed(M.elements(M.trees(_pages(spark, sf_dir), texts=False), only=lambda x: x["tag"].isin(*LANDMARKS) | x["tag"].rlike("^(a|p|h[1-6])$")))
    marks, others = rows.where(F.col("tag").isin(*LANDMARKS)), rows.where(F.col("tag").rlike("^(a|p|h[1-6])$"))
    pairs = K.contained(marks, others).join(others.select("page_id", F.col("node_id").alias("inner_id"), F.col("tag").alias("inner")), ["page_id", "inner_id"])
    counts = pairs.groupBy("page_id", "node_id").agg(*(F.count_if(F.expr(c.replace("tag", "inner"))).alias(n) for n, c in _HELD.items()))
    return counts.join(marks.select("page_id", "node_id", "tag"), ["page_id", "node_id"]).select("page_id", "node_id", "tag", *_HELD)


_NAMES = ("alt", "id", "for", "type", "title", "placeholder", "role", "lang", "onclick", "aria-label", "aria-labelledby", "aria-hidden", "aria-expanded")
_ATTRIBUTES = ", ".join(f'{_attribute(n)} AS "{n}"' for n in _NAMES)
_LANG = "'^[a-z]{2,3}(-[A-Za-z0-9]+)*$'"
_FOUND = rf"""{_TREE},
    e AS (SELECT t.*, coalesce(text, '') AS text, {_ATTRIBUTES} FROM tree t LEFT JOIN worded USING (page_id, node_id) WHERE tag <> '#text'),
    n AS (SELECT *, "aria-label" IS NOT NULL OR "aria-labelledby" IS NOT NULL OR title IS NOT NULL AS named FROM e),
    h AS (SELECT page_id, node_id, tag, substr(tag, 2)::INT AS level, lag(substr(tag, 2)::INT) OVER (PARTITION BY page_id ORDER BY node_id) AS before FROM n WHERE regexp_matches(tag, '^h[1-6]$')),
    field AS (SELECT i.*, EXISTS (SELECT 1 FROM n l WHERE l.page_id = i.page_id AND l.tag = 'label' AND (l."for" = i.id OR (i.node_id > l.node_id AND i.node_id <= l.exit))) AS labelled FROM n i WHERE tag = 'input' AND coalesce(type, '') NOT IN ('hidden', 'submit', 'button')),
    found AS (
      SELECT page_id, node_id, tag, 'img-alt' AS rule, 'error' AS severity FROM n WHERE tag = 'img' AND alt IS NULL
      UNION ALL SELECT page_id, node_id, tag, 'img-alt-meaningful', 'warning' FROM n WHERE tag = 'img' AND lower(alt) IN {_in(K.PLACEHOLDERS)}
      UNION ALL SELECT page_id, node_id, tag, 'button-text', 'error' FROM n WHERE tag = 'button' AND text = '' AND NOT named
      UNION ALL SELECT page_id, node_id, tag, 'link-text', 'error' FROM n WHERE tag = 'a' AND text = '' AND NOT named
      UNION ALL SELECT page_id, node_id, tag, 'link-text-descriptive', 'warning' FROM n WHERE tag = 'a' AND text <> '' AND (lower(text) IN {_in(K.VAGUE)} OR length(text) < 3)
      UNION ALL SELECT page_id, node_id, tag, 'aria-role-valid', 'error' FROM n WHERE len(list_filter(string_split_regex(role, '\s+'), lambda r: r <> '' AND NOT list_contains({_list(ROLES)}, r))) > 0
      UNION ALL SELECT page_id, node_id, tag, 'interactive-role', 'warning' FROM n WHERE tag NOT IN ('a', 'button', 'details', 'input', 'select', 'summary', 'textarea') AND onclick IS NOT NULL AND role IS NULL
      UNION ALL SELECT page_id, node_id, tag, 'html-lang', CASE WHEN lang IS NULL THEN 'error' ELSE 'warning' END FROM n WHERE tag = 'html' AND (lang IS NULL OR NOT regexp_matches(lang, {_LANG}))
      UNION ALL SELECT page_id, node_id, tag, 'aria-hidden-value', 'error' FROM n WHERE "aria-hidden" NOT IN ('true', 'false')
      UNION ALL SELECT page_id, node_id, tag, 'aria-expanded-value', 'error' FROM n WHERE "aria-expanded" NOT IN ('true', 'false')
      UNION ALL SELECT page_id, node_id, tag, 'input-label', CASE WHEN NOT named AND NOT labelled THEN 'error' ELSE 'warning' END FROM field WHERE NOT named AND (NOT labelled OR placeholder IS NOT NULL)
      UNION ALL SELECT page_id, node_id, tag, 'fieldset-legend', CASE WHEN named THEN 'info' ELSE 'warning' END FROM n f WHERE tag = 'fieldset' AND NOT EXISTS (SELECT 1 FROM n l WHERE l.page_id = f.page_id AND l.tag = 'legend' AND l.parent_id = f.node_id)
      UNION ALL SELECT page_id, node_id, tag, CASE WHEN before IS NULL THEN 'heading-hierarchy-start' ELSE 'heading-hierarchy-skip' END, 'warning' FROM h WHERE (before IS NULL AND level <> 1) OR level > before + 1
      UNION ALL SELECT page_id, node_id, tag, 'duplicate-id', 'error' FROM n WHERE id <> '' QUALIFY count(*) OVER (PARTITION BY page_id, id) > 1)"""


def _findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = G.checkpointed(M.elements(M.trees(_pages(spark, sf_dir), texts=False), texts=K.TEXTED))
    return nodes, K.findings(nodes)


@query("page_findings", f"WITH RECURSIVE {_FOUND} SELECT page_id, node_id, tag, rule, severity FROM found")
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all accessibility rules over the trees of all pages."""
    return _findings(spark, sf_dir)[1]


_HOST = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"


@query(
    "finding_summaries",
    f"""WITH RECURSIVE {_FOUND}, f AS (SELECT found.page_id, {_HOST} AS host, rule, severity FROM found JOIN source USING (page_id))
    SELECT 'total' AS level, NULL AS host, NULL AS rule, NULL AS severity, count(*) AS findings, count(DISTINCT page_id) AS pages FROM f
    UNION ALL SELECT 'severity', NULL, NULL, severity, count(*), count(DISTINCT page_id) FROM f GROUP BY severity UNION ALL SELECT 'rule', NULL, rule, NULL, count(*), count(DISTINCT page_id) FROM f GROUP BY rule
    UNION ALL SELECT 'host', host, NULL, NULL, count(*), count(DISTINCT page_id) FROM f GROUP BY host UNION ALL SELECT 'host and severity', host, NULL, severity, count(*), count(DISTINCT page_id) FROM f GROUP BY host, severity""",
)
def finding_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity, rule, host, host and severity, and in all, in one pass."""
    found = _findings(spark, sf_dir)[1]
    hosts = _pages(spark, sf_dir).select("page_id", F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1).alias("host"))
    return K.summaries(found.join(hosts, "page_id"))


_COST = "CASE severity " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in PENALTIES.items()) + " END"


@query(
    "page_accessibility",
    f"""WITH RECURSIVE {_FOUND}, c AS (SELECT page_id, count(*) AS elements FROM n GROUP BY 1),
    v AS (SELECT page_id, count(*) AS violations, count(DISTINCT node_id) AS hit, sum({_COST}) AS cost, count_if(severity = 'error') AS errors, count_if(severity = 'error' AND rule NOT IN {_in(LEVEL_AA)}) AS a, count_if(severity = 'warning' AND rule IN {_in(LEVEL_AA)}) AS aa FROM found GROUP BY 1)
    SELECT page_id, elements, coalesce(violations, 0) AS violations, greatest(0, floor((elements - coalesce(hit, 0)) / elements * 100 - least(2 * coalesce(cost, 0), 50) + 0.5))::BIGINT AS score,
      CASE WHEN coalesce(errors, 0) = 0 AND coalesce(aa, 0) = 0 THEN 'AAA' WHEN coalesce(errors, 0) = 0 THEN 'AA' WHEN coalesce(a, 0) = 0 THEN 'A' ELSE 'none' END AS level FROM c LEFT JOIN v USING (page_id)""",
)
def page_accessibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and level of each page."""
    return K.scores(*_findings(spark, sf_dir))


#: Subtrees in SQL are written out, as tags with what is inside of them: those that are equal are written alike.
_SHAPES = f"""{_TREE}, el AS (SELECT * FROM tree WHERE tag <> '#text'), levels AS (SELECT max(depth) AS top FROM el),
    up AS (SELECT e.page_id, e.node_id, e.parent_id, e.depth, string_agg('(' || x.depth - e.depth || x.tag, '' ORDER BY x.node_id) AS shape, count(*) AS size FROM el e JOIN el x ON x.page_id = e.page_id AND x.node_id >= e.node_id AND x.node_id <= e.exit GROUP BY 1, 2, 3, 4),
    g AS (SELECT shape, any_value(size) AS size, count(*) AS copies, count(DISTINCT page_id) AS pages, min(struct_pack(p := page_id, n := node_id)) AS first FROM up WHERE size >= 3 GROUP BY shape HAVING count(*) > 1),
    inside AS (SELECT u.shape, o.shape AS above, count(*) AS n FROM up u JOIN up o ON o.page_id = u.page_id AND o.node_id = u.parent_id GROUP BY 1, 2),
    covered AS (SELECT i.shape FROM inside i JOIN g a ON a.shape = i.above JOIN g s ON s.shape = i.shape WHERE i.n = s.copies AND a.copies = s.copies)"""


@query("repeated_subtrees", f"WITH RECURSIVE {_SHAPES} SELECT size::INT AS size, copies, pages, first.p AS first_page, first.n AS first_node FROM g WHERE shape NOT IN (SELECT shape FROM covered)")
def repeated_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest shapes of elements that come more than once on or across pages."""
    return K.repeated_subtrees(K.subtrees(M.trees(_pages(spark, sf_dir), texts=False))).drop("digest")


_BAGS = f"""{_TREE}, item AS (SELECT page_id, tag || '@' || depth AS item, count(*) AS n FROM tree WHERE tag <> '#text' GROUP BY 1, 2),
    bag AS (SELECT page_id, list(struct_pack(i := item, n := n) ORDER BY item) AS bag, sum(n) AS size FROM item GROUP BY 1), class AS (SELECT bag, min(page_id) AS id, any_value(size) AS size FROM bag GROUP BY 1),
    held AS (SELECT c.id, i.item, i.n FROM class c JOIN item i ON i.page_id = c.id),
    pair AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS common FROM held a JOIN held b ON a.item = b.item AND a.id < b.id GROUP BY 1, 2)"""


@query(
    "page_templates",
    f"""WITH RECURSIVE {_BAGS} SELECT p.a, p.b, p.common::BIGINT AS common, (x.size + y.size - p.common)::BIGINT AS total FROM pair p JOIN class x ON x.id = p.a JOIN class y ON y.id = p.b WHERE p.common * 100 >= (x.size + y.size - p.common) * 80""",
)
def page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of pages with the same tags at the same depths whose weighted Jaccard index is 0.8 and more."""
    pairs, _ = K.alike_bags(K.bags(M.trees(_pages(spark, sf_dir), texts=False)))
    return pairs.select("a", "b", F.col("common").cast("long").alias("common"), F.col("total").cast("long").alias("total"))


@query("page_template_members", f"WITH RECURSIVE {_BAGS} SELECT b.page_id, c.id AS bag_id FROM bag b JOIN class c ON c.bag = b.bag")
def page_template_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which page is of which class."""
    return K.alike_bags(K.bags(M.trees(_pages(spark, sf_dir), texts=False)))[1]
