"""Line metrics, keywords, duplicates and token estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import findings as R
from quarry.plans.common import table, values
from quarry.registry import query

#: The fold of the line counter, in SQL: state is (documentation, block comment, code, comment, blank).
_FOLD = """
list_reduce(
  list_prepend({'t': '', 'doc': false, 'block': false, 'code': 0, 'comment': 0, 'blank': 0},
    list_transform(string_split(CONTENT, chr(10)), lambda x: {'t': regexp_replace(x, '^\\s+|\\s+$', '', 'g'), 'doc': false, 'block': false, 'code': 0, 'comment': 0, 'blank': 0})),
  lambda s, x: {
    't': x.t,
    'doc': CASE WHEN x.t = '' THEN s.doc ELSE contains(x.t, '/**') OR (s.doc AND NOT contains(x.t, '*/')) END,
    'block': CASE WHEN x.t <> '' AND NOT (s.doc OR contains(x.t, '/**')) AND (s.block OR contains(x.t, '/*')) THEN NOT contains(x.t, '*/') ELSE s.block END,
    'code': s.code + CASE WHEN x.t <> '' AND NOT (s.doc OR contains(x.t, '/**')) AND NOT (s.block OR contains(x.t, '/*')) AND NOT starts_with(x.t, '//') THEN 1 ELSE 0 END,
    'comment': s.comment + CASE WHEN x.t <> '' AND NOT (s.doc OR contains(x.t, '/**')) AND (s.block OR contains(x.t, '/*') OR starts_with(x.t, '//')) THEN 1 ELSE 0 END,
    'blank': s.blank + CASE WHEN x.t = '' OR s.doc OR contains(x.t, '/**') THEN 1 ELSE 0 END
  })"""


def _fold(content: str) -> str:
    return _FOLD.replace("CONTENT", content)


_LINES = f"SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n, {_fold('coalesce(text, chr(0) || chr(10))')} AS m FROM documents"

#: Cases of the line counter with their counts (fixed values): name, content, total, code, comment, blank.
LINE_CASES = [
    ("simple", "const x = 1;\n// This is a comment\nconst y = 2;", 3, 2, 1, 0),
    ("mixed line", "const x = 1; // Inline comment\nconst y = 2;", 2, 2, 0, 0),
    ("block comment", "/*\n * Multi-line comment\n * Another line\n */\nconst x = 1;", 5, 1, 4, 0),
    ("documentation", "/**\n * JSDoc comment - should NOT count as comment\n * @param x parameter\n */\nconst func = (x) => x;", 5, 1, 0, 4),
    ("blank lines", "const x = 1;\n\nconst y = 2;\n\n", 5, 2, 0, 3),
    ("complex", "const obj = { // Start object\n  prop: 'value', // Property comment\n  \n  /* Block comment */\n  other: 42\n}; // End object", 6, 4, 1, 1),
    ("one-line documentation", "/** one-line */\nconst a = 1;", 2, 0, 0, 2),
]


def _metrics(docs: DataFrame) -> DataFrame:
    m = docs.select("doc_id", T.line_metrics(F.col("text")).alias("m"))
    return m.select("doc_id", *(F.col(f"m.{c}").cast("long").alias(f"{c}_lines") for c in ("total", "code", "comment", "blank")))


@query("line_metrics", f"SELECT doc_id, n AS total_lines, m.code AS code_lines, m.comment AS comment_lines, m.blank AS blank_lines FROM ({_LINES})")
def line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(table(spark, sf_dir, "documents"))


@query(
    "line_metrics_total",
    f"""SELECT sum(n)::BIGINT AS total_lines, sum(m.code)::BIGINT AS code_lines, sum(m.comment)::BIGINT AS comment_lines, sum(m.blank)::BIGINT AS blank_lines,
    CASE WHEN sum(m.comment) > 0 THEN floor(sum(m.code) * 100.0 / sum(m.comment) + 0.5) / 100 WHEN sum(m.code) > 0 THEN 'Infinity'::DOUBLE ELSE 0.0 END AS code_to_comment,
    abs(sum(m.code) + sum(m.comment) + sum(m.blank) - sum(n)) <= 0.01 * sum(n) AS consistent
    FROM ({_LINES})""",
)
def line_metrics_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _metrics(table(spark, sf_dir, "documents")).agg(*(F.sum(f"{c}_lines").alias(f"{c}_lines") for c in ("total", "code", "comment", "blank")))
    code, comment = F.col("code_lines"), F.col("comment_lines")
    ratio = F.when(comment > 0, T.round_half_up(code / comment, 2)).when(code > 0, float("inf")).otherwise(0.0)
    kept = F.abs(code + comment + F.col("blank_lines") - F.col("total_lines")) <= 0.01 * F.col("total_lines")
    return total.withColumns({"code_to_comment": ratio, "consistent": kept})


@query(
    "line_metrics_cases",
    f"""SELECT name, total AS want_total, code AS want_code, comment AS want_comment, blank AS want_blank, len(string_split(content, chr(10))) AS total_lines, m.code AS code_lines, m.comment AS comment_lines, m.blank AS blank_lines
    FROM (SELECT *, {_fold("content")} AS m FROM {values(LINE_CASES, "name, content, total, code, comment, blank")})""",
)
def line_metrics_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame(LINE_CASES, "name string, content string, want_total int, want_code int, want_comment int, want_blank int")
    m = cases.withColumn("m", T.line_metrics(F.col("content")))
    return m.select("name", "want_total", "want_code", "want_comment", "want_blank", *(F.col(f"m.{c}").alias(f"{c}_lines") for c in ("total", "code", "comment", "blank")))


@query(
    "keyword_topk",
    r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\s]', '', 'g'), '\s+')) AS word, generate_subscripts(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\s]', '', 'g'), '\s+'), 1) AS i FROM documents),
    c AS (SELECT doc_id, word, count(*) AS n, min(i) AS first FROM w WHERE length(word) > 3 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c)
    SELECT doc_id, rank, word, n FROM r WHERE rank <= 10""",
)
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are counted inside of their text's row: sorted with their places, runs of equal ones are counted by where they begin. No text moves."""
    plain = F.regexp_replace(F.lower("text"), r"[^a-z0-9_\s]", "")
    placed = F.filter(F.transform(F.split(plain, r"\s+"), lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda x: F.length(x["word"]) > 3)

    def ranked(words: Column) -> Column:
        n = F.size(words)
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(words, i)["word"] != F.get(words, F.greatest(i - 1, F.lit(0)))["word"]))
        runs = T.let(begins, lambda b: F.transform(b, lambda at, k: F.struct((at - F.coalesce(F.get(b, k + 1), n)).alias("less"), F.get(words, at)["i"].alias("i"), F.get(words, at)["word"].alias("word"))))
        return F.when(n > 0, F.slice(F.sort_array(runs), 1, 10))

    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.let(F.sort_array(placed), ranked)).alias("rank", "x"))
    return docs.select("doc_id", (F.col("rank") + 1).alias("rank"), "x.word", (-F.col("x.less")).cast("long").alias("n"))


#: Addresses of mail, as a report looks for them (a fixed value).
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+"


@query(
    "mail_positions",
    f"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{MAIL}') AS m, string_split_regex(text, '{MAIL}') AS gaps FROM documents WHERE regexp_matches(text, '{MAIL}')),
    k AS (SELECT doc_id, text, unnest(m) AS code, generate_subscripts(m, 1) AS k, m, gaps FROM d),
    placed AS (SELECT doc_id, code, k, text[:(list_sum(list_transform(gaps[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:k - 1], lambda x: length(x))), 0))::BIGINT] AS ahead FROM k)
    SELECT doc_id, (k - 1)::INT AS seq, (length(ahead) - length(replace(ahead, chr(10), '')) + 1)::INT AS line, (length(regexp_extract(ahead, '[^\n]*$')) + 1)::INT AS "column", code FROM placed""",
)
def mail_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of every address in every document."""
    return R.located(table(spark, sf_dir, "documents"), MAIL)


@query(
    "token_estimate_by_lang",
    """SELECT coalesce(lang, '(none)') AS lang, count(*) AS n_docs, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, max(ceil(length(text) / 4.0))::BIGINT AS most
    FROM documents GROUP BY 1""",
)
def token_estimate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.token_estimate(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("(none)")).alias("lang")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).alias("tokens"), F.max(n).alias("most"))


@query(
    "token_estimate_by_role",
    "SELECT role, count(*) AS n_turns, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM conversations GROUP BY 1",
)
def token_estimate_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


@query(
    "identical_texts",
    "SELECT md5(text) AS signature, count(*) AS n, min(doc_id) AS first_doc, count(DISTINCT source) AS n_sources FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
)
def identical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural equality as a group of a signature: no pairs are needed."""
    groups = table(spark, sf_dir, "documents").where("text is not null").groupBy(F.md5("text").alias("signature"))
    return groups.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.countDistinct("source").alias("n_sources")).where("n > 1")


@query(
    "context_complexity",
    """WITH s AS (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, length(text) - length(replace(text, ',', '')) AS commas, length(text) AS n FROM documents WHERE text IS NOT NULL),
    p AS (SELECT *, CASE WHEN n_lines > 200 THEN 3 WHEN n_lines > 100 THEN 2 WHEN n_lines > 50 THEN 1 ELSE 0 END + CASE WHEN commas > 10 THEN 2 WHEN commas > 5 THEN 1 ELSE 0 END AS points FROM s)
    SELECT doc_id, points, CASE WHEN points >= 8 THEN 'very-high' WHEN points >= 5 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS level, ceil(n / 4.0)::BIGINT AS tokens FROM p""",
)
def context_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").where("text is not null")
    lines, commas = F.size(F.split("text", "\n", -1)), F.length("text") - F.length(F.replace("text", F.lit(",")))
    points = F.when(lines > 200, 3).when(lines > 100, 2).when(lines > 50, 1).otherwise(0) + F.when(commas > 10, 2).when(commas > 5, 1).otherwise(0)
    level = F.when(F.col("points") >= 8, "very-high").when(F.col("points") >= 5, "high").when(F.col("points") >= 2, "medium").otherwise("low")
    return s.select("doc_id", points.alias("points"), T.token_estimate(F.col("text")).alias("tokens")).withColumn("level", level).select("doc_id", "points", "level", "tokens")


@query(
    "line_context",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    c AS (SELECT *, lag(line) OVER w AS line_before, lead(line) OVER w AS line_after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n))
    SELECT doc_id, n, line_before, line, line_after FROM c WHERE regexp_matches(line, '[0-9]')""",
)
def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with digits, with the ones before and after."""
    lines = F.split("text", "\n", -1)
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"), F.posexplode(lines).alias("i", "line")).where(F.col("line").rlike("[0-9]"))
    return rows.select("doc_id", (F.col("i") + 1).alias("n"), F.get("lines", F.col("i") - 1).alias("line_before"), "line", F.get("lines", F.col("i") + 1).alias("line_after"))
