"""Scores of customers and suppliers as components: sub-scores, weights, normalisation, ranges, top reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import round_half_up
from quarry.operators import scoring as S
from quarry.operators.selection import at_shares
from quarry.plans.common import table
from quarry.registry import query

_METRICS = """m AS (SELECT c_custkey AS id, coalesce(n, 0) AS orders, coalesce(urgent, 0) AS urgent, greatest(0, least(100, floor(c_acctbal / 100 + 0.5))) AS balance FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n, count_if(o_orderpriority LIKE '1%') AS urgent FROM orders GROUP BY 1) o ON o_custkey = c_custkey)"""
_RAW = f"""{_METRICS}, r AS (SELECT id, floor((least(100, orders * 5) * (0.12 / 0.34) + least(100, urgent * 20) * (0.10 / 0.34) + balance * (0.12 / 0.34)) * CASE WHEN urgent > 3 THEN 1.8 ELSE 1.0 END * CASE WHEN orders = 0 THEN 0.85 ELSE 1.0 END * 100 + 0.5) / 100 AS raw FROM m),
    s AS (SELECT id, least(100.0, raw) AS raw FROM r)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"))
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col("c_acctbal") / 100 + 0.5))).alias("balance"))
    m = m.join(orders, "id", "left").fillna(0, ["orders", "urgent"])
    parts = {"cyclomatic": F.least(F.lit(100), F.col("orders") * 5), "cognitive": F.least(F.lit(100), F.col("urgent") * 20), "coupling": F.col("balance")}
    factors = [(F.col("urgent") > 3, 1.8), (F.col("orders") == 0, 0.85)]
    return m.select("id", S.multiplied(S.weighted(parts), factors).alias("raw"))


@query("weighted_score", f"WITH {_RAW} SELECT id, raw AS score FROM s")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("id", F.col("raw").alias("score"))


@query(
    "score_ranges",
    f"""WITH {_RAW} SELECT CASE WHEN raw >= 80 THEN 'critical' WHEN raw >= 60 THEN 'high' WHEN raw >= 40 THEN 'medium' WHEN raw >= 20 THEN 'low' ELSE 'minimal' END AS range, count(*) AS n, min(raw) AS least, max(raw) AS most FROM s GROUP BY 1""",
)
def score_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).groupBy(S.range_of(F.col("raw")).alias("range")).agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("least"), F.max("raw").alias("most"))


_NORMAL = f"""{_RAW}, q AS (SELECT min(raw) AS lo, max(raw) AS hi, list(raw ORDER BY raw) AS l FROM s), q2 AS (SELECT lo, hi, l[(len(l) * 0.25)::INT + CASE WHEN floor(len(l) * 0.25) < (len(l) * 0.25)::INT THEN 0 ELSE 1 END] AS q1, l[floor(len(l) * 0.75)::INT + 1] AS q3 FROM (SELECT * FROM q)),
    n AS (SELECT id, raw, (raw - lo) / (hi - lo) * 100 * 0.7 + CASE WHEN raw <= q1 THEN coalesce(raw / nullif(q1, 0), 0) * 25 WHEN raw <= q3 THEN 25 + coalesce((raw - q1) / nullif(q3 - q1, 0), 0) * 50 ELSE 75 + coalesce((raw - q3) / nullif(hi - q3, 0), 0) * 25 END * 0.3 AS mixed FROM s, q2),
    z AS (SELECT id, raw, floor(CASE WHEN mixed > 50 THEN least(100.0, 50 + (mixed - 50) * log10(mixed - 49) / log10(51.0)) ELSE mixed END * 100 + 0.5) / 100 AS normalised FROM n)"""


@query("normalised_score", f"WITH {_NORMAL.replace('l[(len(l) * 0.25)::INT + CASE WHEN floor(len(l) * 0.25) < (len(l) * 0.25)::INT THEN 0 ELSE 1 END]', 'l[floor(len(l) * 0.25)::INT + 1]')} SELECT id, raw, normalised FROM z")
def normalised_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.normalised(_raw(spark, sf_dir), "raw")


@query("top_components", f"WITH {_RAW} SELECT id, raw FROM s ORDER BY raw DESC, id LIMIT 20")
def top_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).orderBy(F.desc("raw"), "id").limit(20)


@query(
    "component_complexity",
    """SELECT p_partkey AS id, floor((coalesce(lines, 0) + coalesce(suppliers, 0) + 0.5::DOUBLE * p_size + 1.5::DOUBLE * coalesce(returned, 0)) * CASE WHEN coalesce(suppliers, 0) > 5 THEN 1 + 0.1::DOUBLE * (coalesce(suppliers, 0) - 5) ELSE 1.0::DOUBLE END * 10 + 0.5::DOUBLE) / 10 AS complexity
    FROM part LEFT JOIN (SELECT l_partkey, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers, count_if(l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""",
)
def component_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size").join(lines, "id", "left").fillna(0, ["lines", "suppliers", "returned"])
    zero = F.lit(0)
    return p.select("id", S.component_complexity(F.col("lines"), F.col("suppliers"), F.col("p_size"), F.col("returned"), zero, zero, zero).alias("complexity"))


@query(
    "coupling_degree",
    """SELECT l_suppkey AS id, floor((1 - 1.0 / (count(DISTINCT l_partkey) + 2 * count(DISTINCT l_returnflag) + count(DISTINCT l_orderkey) + 2 * count(DISTINCT l_linestatus))) * 100 + 0.5) / 100 AS coupling FROM lineitem GROUP BY 1""",
)
def coupling_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(*(F.countDistinct(c).alias(c) for c in ("l_partkey", "l_returnflag", "l_orderkey", "l_linestatus")))
    zero = F.lit(0)
    return n.select("id", S.coupling_degree(F.col("l_partkey"), F.col("l_returnflag"), F.col("l_orderkey"), F.col("l_linestatus"), zero, zero, zero, zero).alias("coupling"))


@query(
    "maintainability_index",
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w, len(string_split(text, chr(10))) AS n_lines FROM documents), v AS (SELECT doc_id, n_lines, len(w) AS n, len(list_distinct(w)) AS d FROM w)
    SELECT doc_id, floor(greatest(0.0, least(100.0, greatest(0.0, (171 - 5.2 * ln(greatest(CASE WHEN d > 0 THEN n * log2(d) ELSE 0.0 END, 1.0)) - 0.23 * n_lines - 16.2 * ln(greatest(n_lines, 1.0))) * 100 / 171))) * 100 + 0.5) / 100 AS maintainability FROM v""",
)
def maintainability_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a text: words are operands, lines stand for branches."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"), F.size(F.split("text", "\n", -1)).alias("lines"))
    volume = S.halstead_volume(F.size("w"), F.size(F.array_distinct("w")))
    zero = F.lit(0.0)
    return w.select("doc_id", S.maintainability(volume, F.col("lines"), F.col("lines"), zero, zero, zero).alias("maintainability"))


@query(
    "score_statistics",
    f"WITH {_RAW} SELECT count(*) AS n, floor(avg(raw) * 100 + 0.5) / 100 AS average, min(raw) AS least, max(raw) AS most, count_if(raw >= 60) AS problems FROM s",
)
def score_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return raw.agg(F.count(F.lit(1)).alias("n"), round_half_up(F.avg("raw"), 2).alias("average"), F.min("raw").alias("least"), F.max("raw").alias("most"), F.count_if(F.col("raw") >= 60).alias("problems"))


@query(
    "price_quartiles",
    """WITH l AS (SELECT list(l_extendedprice::DOUBLE ORDER BY l_extendedprice) AS l FROM lineitem) SELECT len(l) AS n, l[1] AS lo, l[floor(len(l) * 0.25)::BIGINT + 1] AS q1, l[floor(len(l) * 0.5)::BIGINT + 1] AS median, l[floor(len(l) * 0.75)::BIGINT + 1] AS q3, l[len(l)] AS hi FROM l""",
)
def price_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics of a column with nearly as many values as rows."""
    n, found = at_shares(table(spark, sf_dir, "lineitem"), "l_extendedprice", (0.0, 0.25, 0.5, 0.75, 1.0))
    return spark.createDataFrame([(n, *found)], "n long, lo double, q1 double, median double, q3 double, hi double")
