"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Counts are of words (runs of characters other than ASCII white space) and lines of the whole text. Repeated words are those inside
an 8-word window that the text holds twice or more; windows are compared by a 64-bit hash within one text (for a text of a million
words the chance of any clash is about 3e-8).

Cases: a null or empty text has no words and fails the base rule; a missing count can't occur; ratios of an empty text are 0;
rows stay one to one with the input, so repeated rows, null ids and ties need no rule; other columns aren't read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let, words

SYMBOLS = "#*$%&|<>"
#: Common short words of four languages (fixed values).
STOP_WORDS = (
    "the of and to a in that is was for it with as on be at by this are or from an not have "
    "der die das und in zu den ist von mit sich des auf für nicht ein eine als auch es an dem im war "
    "le la les et de des un une du en est que qui dans pour pas au sur par plus elle il se ce "
    "el los las y que en un una por con para es su al lo como más o se del"
).split()


class Rule(NamedTuple):
    """A text fails the rule if ``measure`` is below ``least`` or above ``most``; it applies from ``from_words`` words on."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The verdict's rules: a row each, tried in this order.
RULES = (
    Rule("too_short", "n_words", least=20),
    Rule("repeated_words", "100 * n_repeat_words / n_words", most=30),
    Rule("word_length", "word_chars / n_words", least=2, most=14),
    Rule("symbols", "n_symbols / n_words", most=0.1),
    Rule("duplicate_lines", "n_dup_lines / n_lines", most=0.3),
    Rule("few_letters", "n_letter_words / n_words", least=0.7),
    Rule("no_stop_words", "n_stop_words / n_words", least=0.01, from_words=50),
)


def _windows(found: Column, k: int) -> Column:
    """A hash for each k-word window."""
    n = F.size(found)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(found, i, k)))).otherwise(F.array().cast("array<bigint>"))


def _repeated_words(hashes: Column, k: int) -> Column:
    """How many words lie in windows whose hash comes twice: sort (hash, position), keep equal neighbours, add up their cover."""

    def count(p: Column) -> Column:
        h = lambda i: F.get(p, i).h
        twice = F.filter(p, lambda x, i: F.coalesce(x.h == h(i - 1), F.lit(False)) | F.coalesce(x.h == h(i + 1), F.lit(False)))
        at = F.sort_array(F.transform(twice, lambda x: x.i))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        add = lambda s, i: F.struct((i + k).alias("end"), (s.n + i + k - F.greatest(s.end, i)).alias("n"))
        return F.aggregate(at, start, add, lambda s: s.n)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, count))


def measures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 8) -> DataFrame:
    """doc_id and every count that a rule can use."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return (
        docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), words(body).alias("found"), lines.alias("lines"))
        .select(
            "doc_id",
            F.size("found").cast("long").alias("n_words"),
            F.length(F.array_join("found", "")).cast("long").alias("word_chars"),
            (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.size(F.filter("found", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter("found", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
            let(_windows(F.col("found"), window), lambda h: _repeated_words(h, window)).cast("long").alias("n_repeat_words"),
        )
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row fails, as one array expression."""

    def fails(r: Rule) -> Column:
        value = F.coalesce(F.expr(f"try_divide({r.measure.replace(' / ', ', ')})") if " / " in r.measure else F.expr(r.measure), F.lit(0))
        out = F.lit(False)
        if r.least is not None:
            out = out | (value < r.least)
        if r.most is not None:
            out = out | (value > r.most)
        return F.when(out & (F.col("n_words") >= r.from_words), F.lit(r.name))

    return F.array_compact(F.array(*map(fails, rules)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The measures, base_failed, kept, and the failed rules by name."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counted = measures(docs, text, doc_id).withColumns({"base_failed": failed, "failed_rules": compile_rules(rules)})
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules",
    )
