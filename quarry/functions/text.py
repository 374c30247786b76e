"""Scalar text functions with the semantics that source-tree reports are defined by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity, as script engines do."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def line_metrics(content: Column) -> Column:
    """struct(total, code, comment, blank): a fold over the lines with two states, documentation and block comment.

    A line with /** opens documentation (counted blank, as are its lines up to one with */); a line with /* opens a comment; a line
    that starts with // is a comment, and one with code before // is code."""
    # Each line is stripped once and comes to five bits, so that the fold itself is arithmetic.
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")))
    bit = lambda c, n: F.when(c, n).otherwise(0)
    flags = F.transform(lines, lambda x: F.when(x == "", 1).otherwise(bit(x.contains("/**"), 2) + bit(x.contains("*/"), 4) + bit(x.contains("/*"), 8) + bit(x.startswith("//"), 16)))

    def step(s: Column, x: Column) -> Column:
        has = lambda n: x.bitwiseAND(n) > 0
        blank, opens, closes = has(1), has(2), has(4)
        doc = ~blank & (s.doc | opens)
        block = ~blank & ~doc & (s.block | has(8))
        comment = block | (~blank & ~doc & has(16))
        code = ~blank & ~doc & ~comment
        return F.struct(
            F.when(blank, s.doc).otherwise(opens | (s.doc & ~closes)).alias("doc"),
            F.when(block, ~closes).otherwise(s.block).alias("block"),
            (s.code + bit(code, 1)).alias("code"),
            (s.comment + bit(comment, 1)).alias("comment"),
            (s.blank + bit(blank | doc, 1)).alias("blank"),
        )

    zero = F.struct(F.lit(False).alias("doc"), F.lit(False).alias("block"), F.lit(0).alias("code"), F.lit(0).alias("comment"), F.lit(0).alias("blank"))
    return F.aggregate(flags, zero, step, lambda s: F.struct((s.code + s.comment + s.blank).alias("total"), s.code.alias("code"), s.comment.alias("comment"), s.blank.alias("blank")))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.substring(a, F.lit(1), F.array_max(same))


def naming_pattern(name: Column) -> Column:
    """The case style of an identifier."""
    return (
        F.when(name.rlike(r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$|^[A-Z]{2,}$"), "CONSTANT_CASE")
        .when(name.rlike(r"^[A-Z][A-Za-z0-9]*$"), "PascalCase")
        .when(name.rlike(r"^[a-z][a-z0-9]*$"), "lowercase")
        .when(name.rlike(r"^[a-z][A-Za-z0-9]*$"), "camelCase")
        .when(name.rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$"), "snake_case")
        .when(name.rlike(r"^[a-z][a-z0-9]*(-[a-z0-9]+)+$"), "kebab-case")
        .otherwise("other")
    )


def hash32(text: Column) -> Column:
    """The rolling 31-hash over code points, wrapped to signed 32 bits."""
    chars = F.split(text, "")
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + F.ascii(c).cast("long")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once: a lambda variable is evaluated once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def passing(state: Column, value: Column, body: Callable[[Column], Column]) -> Column:
    """The next state of a fold from a value bound once. ``let`` copies what its body gives; a fold hands it on, which matters where a
    state holds what was put out so far."""
    return F.aggregate(F.array(value), state, lambda _, x: body(x))


def prefix_sums(sizes: Column) -> Column:
    """For each number of an array the sum up to it. A block of 64 is summed at a time, so that a long array isn't copied for each of its numbers."""
    none = F.array().cast("array<int>")

    def block(a: Column, at: Column) -> Column:
        step = lambda b, x: F.struct((b["sum"] + x).alias("sum"), F.concat(b["out"], F.array(b["sum"] + x)).alias("out"))
        inner = F.aggregate(F.slice(sizes, at + 1, 64), F.struct(a["sum"].alias("sum"), none.alias("out")), step)
        return passing(a, inner, lambda b: F.struct(b["sum"].alias("sum"), F.concat(a["outs"], F.array(b["out"])).alias("outs")))

    blocks = F.when(F.size(sizes) > 0, F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(64))).otherwise(none)
    return F.aggregate(blocks, F.struct(F.lit(0).alias("sum"), F.array().cast("array<array<int>>").alias("outs")), block, lambda a: F.flatten(a["outs"]))


def match_positions(content: Column, pattern: str) -> Column:
    """array of struct(code, index): all matches of a pattern that matches no empty text, with their places from 0. A match starts after all that
    stands between matches and all matches before it."""
    matches = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))

    def placed(found: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(content, pattern, -1), 1, F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m))
        return let(prefix_sums(sizes), lambda ends: F.transform(found, lambda m, i: F.struct(m.alias("code"), (F.get(ends, i) - F.length(m)).alias("index"))))

    none = F.array().cast("array<struct<code:string,index:int>>")
    return let(matches, lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def line_starts(content: Column) -> Column:
    """The places, from 0, where lines start."""
    sizes = F.transform(F.split(content, "\n", -1), lambda x: F.length(x) + 1)
    return let(prefix_sums(sizes), lambda ends: F.slice(F.concat(F.array(F.lit(0)), ends), 1, F.size(ends)))


def line_and_column(content: Column, index: Column) -> Column:
    """struct(line, column), both from 1, of a 0-based character index."""
    return let(line_starts(content), lambda starts: place_in(starts, index))


def place_in(starts: Column, index: Column) -> Column:
    """struct(line, column), both from 1, of a 0-based character index: a binary search among the starts of lines, bit by bit."""
    last = F.size(starts)
    search = F.aggregate(
        F.array(*(F.lit(1 << b) for b in range(30, -1, -1))), F.lit(0),
        lambda at, step: F.when((at + step < last) & (F.get(starts, F.least(at + step, last - 1)) <= index), at + step).otherwise(at),
    )
    return let(search, lambda at: F.struct((at + 1).alias("line"), (index - F.get(starts, at) + 1).alias("column")))
