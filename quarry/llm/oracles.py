"""SQL (DuckDB) for the queries that have one."""

from __future__ import annotations

from quarry.llm.quality import STOP_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_SPLIT = f"w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w)"


def _windows(k: int) -> str:
    over = f"OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"
    return f"win AS (SELECT doc_id, i, s FROM (SELECT doc_id, i, string_agg(x, ' ') {over} AS s, count(*) {over} AS c FROM u) WHERE c = {k})"


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

OP4 = f"""WITH {_SPLIT}, {_windows(8)},
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(8) r(k) GROUP BY doc_id),
per AS (SELECT doc_id, sum(length(x)) AS word_chars, count_if(lower(x) IN ({_STOP})) AS stops, count_if(regexp_matches(x, '\\p{{L}}')) AS letters FROM u GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
m AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(per.word_chars, 0)::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(cov.n, 0) AS n_repeat_words, coalesce(stops, 0) AS stops, coalesce(letters, 0) AS letters
  FROM w JOIN lines USING (doc_id) LEFT JOIN per USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words AND word_chars >= 2 * n_words AND word_chars <= 14 * n_words AND n_symbols / n_words <= 0.1 AND n_dup_lines / n_lines <= 0.3
  AND letters / n_words >= 0.7 AND (n_words < 50 OR stops / n_words >= 0.01) AS kept FROM m"""

OP3 = f"""WITH {_SPLIT}, {_windows(13)},
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS src FROM win) WHERE src < doc_id),
cov AS (SELECT DISTINCT doc_id, i + k AS i FROM rep, range(13) r(k)),
left_ AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.i) AS kept, count(*) AS n FROM u LEFT JOIN cov ON cov.doc_id = u.doc_id AND cov.i = u.i WHERE cov.i IS NULL GROUP BY u.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(left_.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN left_ USING (doc_id)"""

OP8 = f"""WITH RECURSIVE d AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
{_SPLIT.replace("FROM documents", "FROM d")}, {_windows(5)},
s AS (SELECT DISTINCT doc_id, md5(s) AS s FROM win UNION ALL SELECT doc_id, md5(array_to_string(w, ' ')) FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))),
edges AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT walk.node, edges.b FROM walk JOIN edges ON edges.a = walk.other),
c AS (SELECT node, min(other) AS component_id FROM walk GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.node = w.doc_id"""

ORACLES = {"op3_substrings": OP3, "op4_quality": OP4, "op8_near_duplicates": OP8}
