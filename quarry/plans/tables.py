"""Names and sets: similar names, naming statistics, Jaccard pairs, value distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import round_half_up
from quarry.operators import similarity as S
from quarry.plans.common import table
from quarry.registry import query


@query(
    "name_similarity_pairs",
    """WITH n AS (SELECT p_name AS name, p_brand AS brand, min(p_partkey) AS id FROM part GROUP BY 1, 2)
    SELECT a.id AS a, b.id AS b, levenshtein(a.name, b.name)::INT AS distance FROM n a JOIN n b ON a.brand = b.brand AND a.id < b.id WHERE levenshtein(a.name, b.name) <= floor(0.3 * greatest(length(a.name), length(b.name)))""",
)
def name_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names within a block (the brand) at an edit distance of at most three tenths of the longer one."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("block")).agg(F.min("p_partkey").alias("id"))
    return S.similar_names(names, 0.3)


@query(
    "jaccard_pairs",
    """WITH p AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_partkey)) AS s FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 2),
    e AS (SELECT id, unnest(s) AS x, len(s) AS n FROM p), i AS (SELECT a.id AS a, b.id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2)
    SELECT a, b, floor(common * 1000.0 / (na + nb - common) + 0.5) / 1000 AS similarity FROM i WHERE common > 0.5 * (na + nb - common)""",
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose sets of parts are more than half alike, by an inverted index with a prefix filter."""
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("s")).where("size(s) >= 2")
    return S.jaccard_pairs(sets, 0.5)


@query(
    "naming_patterns",
    r"""SELECT pattern, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(w, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$|^[A-Z]{2,}$') THEN 'CONSTANT_CASE' WHEN regexp_matches(w, '^[A-Z][A-Za-z0-9]*$') THEN 'PascalCase' WHEN regexp_matches(w, '^[a-z][a-z0-9]*$') THEN 'lowercase'
    WHEN regexp_matches(w, '^[a-z][A-Za-z0-9]*$') THEN 'camelCase' WHEN regexp_matches(w, '^[a-z][a-z0-9]*(_[a-z0-9]+)+$') THEN 'snake_case' WHEN regexp_matches(w, '^[a-z][a-z0-9]*(-[a-z0-9]+)+$') THEN 'kebab-case' ELSE 'other' END AS pattern
    FROM (SELECT p_type AS w FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT event_type FROM events)) GROUP BY 1""",
)
def naming_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.functions.text import naming_pattern

    sources = (("part", "p_type"), ("part", "p_brand"), ("customer", "c_mktsegment"), ("supplier", "s_name"), ("events", "event_type"))
    words = [table(spark, sf_dir, t).select(F.col(c).alias("w")) for t, c in sources]
    every = words[0]
    for w in words[1:]:
        every = every.union(w)
    return every.groupBy(naming_pattern(F.col("w")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prefix_suffix_patterns",
    "SELECT 'prefix' AS kind, left(p_name, 3) AS part, count(*) AS n FROM part GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'suffix', right(p_name, 5), count(*) FROM part GROUP BY 2 HAVING count(*) > 1",
)
def prefix_suffix_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(F.struct(F.lit("prefix").alias("kind"), F.expr("left(p_name, 3)").alias("part")), F.struct(F.lit("suffix").alias("kind"), F.expr("right(p_name, 5)").alias("part")))
    rows = table(spark, sf_dir, "part").select(F.explode(ends).alias("x")).select("x.kind", "x.part")
    return rows.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "type_distribution",
    "SELECT p_type AS type, count(*) AS n, floor(count(*) * 10000.0 / sum(count(*)) OVER () + 0.5) / 100 AS percent FROM part GROUP BY 1",
)
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with their share; the total is a window over one row a type."""
    from pyspark.sql import Window as W

    n = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", round_half_up(F.col("n") * 100 / F.sum("n").over(W.partitionBy()), 2))


@query(
    "key_count_histogram",
    """SELECT range, count(*) AS n FROM (SELECT CASE WHEN n <= 10 THEN '1-10' WHEN n <= 50 THEN '11-50' WHEN n <= 100 THEN '51-100' WHEN n <= 500 THEN '101-500' ELSE '501+' END AS range FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)) GROUP BY 1""",
)
def key_count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("k"))
    k = F.col("k")
    return per.groupBy(F.when(k <= 10, "1-10").when(k <= 50, "11-50").when(k <= 100, "51-100").when(k <= 500, "101-500").otherwise("501+").alias("range")).agg(F.count(F.lit(1)).alias("n"))
