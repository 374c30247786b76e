"""Maximal periodic runs of a text's words, by the runs theorem.

A run is a stretch with smallest period p of at least two periods that no neighbouring word extends. Under one of two orders of the words
(any order and its reverse) each run holds a root of p words that is the longest Lyndon word starting at its place. The longest Lyndon word at a
place ends before the next smaller value of the inverse suffix array, in the first order, or before the next greater one, in the
reverse order, so a text of n words has at most 2n candidates. A candidate (place i, period p) grows to the right by the longest common prefix of
the suffixes at i and i + p, to the left by that of the reversed text: both are minima of a stretch of the LCP array, asked of a sparse table.

Many texts are worked on at once as one array of word numbers with a separator after each text; the symbols of a text rank below those
of the next, so that suffix arrays lie one after another and no match crosses a border. Suffixes are ranked by prefix doubling, where only
those not yet told apart are sorted again; next smaller values are found in a tree of minima; LCP values come from the places whose
value doesn't follow from the place before (their sum is O(n log n)). Only texts with candidates that are long enough get LCP arrays.
Time is O(n log n) for a text, also one that is a single repeated word; memory is that of a group of texts of ``GROUP_BYTES``, or of one text that is longer.

Cases: a null, empty or blank text has no word, no run and an empty collapsed text; other white space than one space between words is no
part of the result; repeated rows and null ids give a row each, as the input; other columns aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import let, tidy, words

#: Texts that are worked on at once.
GROUP_BYTES = 2_000_000


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that put keys (not negative) in order, ties by place, and the keys in that order."""
    n = len(key)
    bits = max(1, (n - 1).bit_length())
    if int(key.max()).bit_length() + bits <= 63:
        both = key << bits | np.arange(n)
        both.sort()
        return both & ((1 << bits) - 1), both >> bits
    order = np.argsort(key, kind="stable")
    return order, key[order]


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """The inverse suffix array: the rank of each place's suffix. The last symbol of each text must stand nowhere else."""
    n = len(symbols)
    order, key = _sorted(symbols)
    first = np.ones(n + 1, bool)
    first[1:n] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first[:n], np.arange(n), 0))
    slots, step = np.flatnonzero(~(first[:n] & first[1:])), 1
    while len(slots):
        at = order[slots]
        # Suffixes that are alike so far hold no end of a text, so that at + step stays inside of it.
        again, key = _sorted(rank[at] * n + rank[at + step])
        at = order[slots] = at[again]
        first[slots[0]] = True
        first[slots[1:]] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(first[slots], slots, 0))
        slots = slots[~(first[slots] & first[slots + 1])]
        step *= 2
    return rank


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the first one after it with a smaller value, or the number of values: up a tree of minima and down again."""
    n = len(values)
    bottom = np.full(1 << n.bit_length(), -1, np.int64)
    bottom[:n] = values
    levels = [bottom]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    who, node, stopped = np.arange(n), np.arange(1, n + 1), []
    for level in levels:
        found_who, found_node = [], []
        for right in (False, True):  # a left child's sibling is looked at too before going up
            look = np.flatnonzero(node & 1 == 1) if right else np.arange(len(node))
            hit = level[node[look]] < values[who[look]]
            found_who.append(who[look[hit]])
            found_node.append(node[look[hit]])
            node[look] += 1
            left = np.ones(len(node), bool)
            left[look[hit]] = False
            who, node = who[left], node[left]
        stopped.append((np.concatenate(found_who), np.concatenate(found_node)))
        node >>= 1
        if not len(node):
            break
    who, node = stopped[-1]
    for k in range(len(stopped) - 2, -1, -1):
        node = 2 * node
        node += levels[k][node] >= values[who]
        who, node = np.concatenate([who, stopped[k][0]]), np.concatenate([node, stopped[k][1]])
    out = np.empty(n, np.int64)
    out[who] = node
    return out


def _common(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols agree from places a and b on, pair by pair."""
    length, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for _ in range(32):
        live = live[symbols[a[live] + length[live]] == symbols[b[live] + length[live]]]
        if not len(live):
            return length
        length[live] += 1
    for k in live.tolist():
        x, y, step = int(a[k] + length[k]), int(b[k] + length[k]), 64
        while True:
            m = min(step, len(symbols) - max(x, y))
            differ = symbols[x : x + m] != symbols[y : y + m]
            at = int(differ.argmax())
            if differ[at]:
                length[k] = x + at - a[k]
                break
            x, y, step = x + m, y + m, 2 * step
    return length


class CommonPrefixes:
    """Longest common prefixes of any two suffixes: LCP array and a sparse table of minima over its blocks."""

    BLOCK = 16

    def __init__(self, symbols: np.ndarray, rank: np.ndarray):
        n, self.rank = len(symbols), rank
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        before = order[rank - 1]
        # A place whose symbol before equals that before its neighbour in order has one less than the place before it.
        own = (np.arange(n) == 0) | (before == 0) | (symbols[np.arange(n) - 1] != symbols[before - 1]) | (rank == 0)
        at = np.flatnonzero(own & (rank > 0))
        value = np.zeros(n, np.int64)
        value[at] = _common(symbols, at, before[at])
        last = np.maximum.accumulate(np.where(own, np.arange(n), 0))
        lcp = np.full(-(-n // self.BLOCK) * self.BLOCK, n, np.int32)
        lcp[rank] = value[last] - (np.arange(n) - last)
        self.blocks = lcp.reshape(-1, self.BLOCK)
        self.table = [self.blocks.min(axis=1)]
        while 2 ** len(self.table) <= len(self.blocks):
            half, top = 2 ** (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(top[:-half], top[half:]))

    def _inside(self, block: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least value of a block from lo to hi."""
        i = np.arange(self.BLOCK)
        return np.where((i >= lo[:, None]) & (i <= hi[:, None]), self.blocks[block], np.iinfo(np.int32).max).min(axis=1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([self._of(a[i : i + 65_536], b[i : i + 65_536]) for i in range(0, len(a), 65_536)] or [np.empty(0, np.int32)]).astype(np.int64)

    def _of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b])
        first, last, size = lo // self.BLOCK, hi // self.BLOCK, self.BLOCK
        end = np.where(first == last, hi % size, size - 1)
        out = np.minimum(self._inside(first, lo % size, end), self._inside(last, np.where(first == last, lo % size, 0), hi % size))
        k = np.where(last - first > 1, np.frexp(np.maximum(last - first - 1, 1))[1] - 1, -1)
        for level in np.unique(k[k >= 0]).tolist():
            i = np.flatnonzero(k == level)
            t = self.table[level]
            out[i] = np.minimum(out[i], np.minimum(t[first[i] + 1], t[last[i] - 2**level]))
        return out


def find(symbols: np.ndarray, sizes: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of max(least, exponent * period) symbols and more: text, start within it, length, period, by text, start, period.

    symbols: word numbers from 0, text after text; sizes: each text's number of words."""
    texts = len(sizes)
    none = np.empty(0, np.int64)
    if not texts:
        return none, none, none, none
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.repeat(np.arange(texts), sizes + 1)
    word = np.ones(base[-1], bool)
    word[base[1:] - 1] = False
    marked = np.zeros(base[-1], np.int64)
    marked[word] = symbols.astype(np.int64) + 1
    marked += text * (int(marked.max(initial=0)) + 1)
    rank = suffix_ranks(marked)
    places = np.flatnonzero(word)

    def needed(period: np.ndarray) -> np.ndarray:
        """How far the leftmost root of a run must agree with what follows it: the run's length less two periods and one more."""
        return np.maximum(np.maximum(least, exponent * period) - 2 * period + 1, 1)

    found = []
    for values in (rank, np.where(word, len(rank) - rank, 0)):
        period = next_smaller(values)[places] - places
        other = places + period
        same = marked[places] == marked[other]
        at, period = places[same], period[same]
        same = (marked[at + 1] == marked[at + 1 + period]) | (needed(period) < 2)
        found.append((at[same], period[same]))
    at, period = (np.concatenate(x) for x in zip(*found, strict=True))

    def inside(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the texts that hold ``at``, and how far a text's places move when the others are left out."""
        kept = np.zeros(texts, bool)
        kept[text[at]] = True
        shift = np.concatenate([[0], np.cumsum(np.where(kept, sizes + 1, 0))])[:-1] - base[:-1]
        return np.flatnonzero(kept[text]), shift

    if not len(at):
        return none, none, none, none
    of, shift = inside(at)
    shared = CommonPrefixes(marked[of], rank[of] + shift[text[of]])
    x = at + shift[text[at]]
    ahead = shared.of(x, x + period)
    keep = ahead >= needed(period)
    at, period, ahead = at[keep], period[keep], ahead[keep]
    if not len(at):
        return none, none, none, none
    of, shift = inside(at)
    turned = of.copy()
    turned[word[of]] = (base[text[of]] + base[text[of] + 1] - 2 - of)[word[of]]
    reverse = marked[turned]
    shared = CommonPrefixes(reverse, suffix_ranks(reverse))
    t = text[at]
    back = np.zeros(len(at), np.int64)
    grow = np.flatnonzero(at > base[t])
    x = (base[t] + base[t + 1] - 2 - (at - 1) + shift[t])[grow]
    back[grow] = shared.of(x, x - period[grow])
    start, length = at - back - base[t], back + period + ahead
    keep = length >= np.maximum(least, exponent * period)
    rows = np.unique(np.stack([t, start, period, length], axis=1)[keep], axis=0)
    return rows[:, 0], rows[:, 1], rows[:, 3], rows[:, 2]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _group(texts: list[bytes | None], least: int, exponent: int) -> pa.StructArray:
    split = [(t or b"").split() for t in texts]  # bytes are split at the six white-space characters
    number = _Numbers()
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    symbols = np.fromiter((number[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
    text, start, length, period = find(symbols, sizes, least, exponent)
    ends = np.searchsorted(text, np.arange(len(split) + 1))
    collapsed = []
    for ws, lo, hi in zip(split, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if lo < hi:
            step = np.zeros(len(ws) + 1, np.int64)
            np.add.at(step, start[lo:hi] + period[lo:hi], 1)
            np.add.at(step, start[lo:hi] + length[lo:hi], -1)
            ws = [ws[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
        collapsed.append(b" ".join(ws))
    found = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
    # Words are whole runs of characters, so that what is joined is UTF-8 as the text was.
    return pa.StructArray.from_arrays([pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), pa.array(collapsed, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


def runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = 24, exponent: int = 3) -> DataFrame:
    """The columns ``keep``, n_words, runs array<struct<start,length,period>> (of max(least, exponent * period) words and more, by start and
    period) and collapsed (the words left when each run keeps its first period alone, joined by one space)."""
    if least < 1 or exponent < 2:
        raise ValueError("a run has at least two periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, held, size, first = b.column(1).cast(pa.binary()), [], 0, 0
            for i, t in enumerate(texts):
                held.append(t.as_py())
                size += len(held[-1] or b"")
                if size >= GROUP_BYTES or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(held)), _group(held, least, exponent)], ["row", "found"])
                    held, size, first = [], 0, i + 1
            tidy()

    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("found", RESULT)]))
    return found.select(*(F.col("row")[c].alias(c) for c in keep), "found.*")


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of the query: the number of runs, the one of greatest exponent, and digests of all runs and of the collapsed text."""
    better = lambda a, x: x["length"] * a["period"] > a["length"] * x["period"]
    # Runs come by start and period, so that the first of equals stays.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(better(a, x), x).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents (by crc32 of the id) goes on periodically from a word on, as the query's contract has it."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeat(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + F.pmod(i - a, p)).cast("int"))).otherwise(x)), " ")

    chosen = (F.pmod(h, F.lit(10)) == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return rows.select("doc_id", F.when(chosen, let(words(F.col("text")), repeat)).otherwise(F.col("text")).alias("text"))
