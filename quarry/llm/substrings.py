"""Removal of word sequences that other documents hold, over a de Bruijn graph of word k-mers.

A window of k words is an edge, from the node of its first k-1 words to that of its last k-1. An edge is repeated if it occurs in two
documents; a document with a smaller id, the smallest that is known where rows meet, is its source.

1. Most edges occur once. Every window has an anchor: the smallest hash among its runs of six words. A repeated window has a repeated
   anchor, so anchors (about a fifth as many as words) are counted first, and only windows with a repeated anchor become edges.
2. Edges meet by 95 bits of hash (64 and 31); each occurrence gets its source's coordinates. Occurrences in step with their source are one run.
3. The graph: the sources' texts are read for the ranges that runs name, which gives the nodes between repeated edges. A node with two
   edges in, or two out, is a branch. A path is contracted where no node branches: along a source's own positions to pieces, and from
   the end of a piece to the piece that goes on elsewhere by joins with doubled steps.
4. Runs are laid over the pieces of their source, which gives spans (document, path, place on the path). Each range of a source is
   verified: a digest of its words at the source's coordinates travels to the documents, and must be that of their own words. Words
   that a span covers are removed.

Hot sequences: before a shuffle each batch combines its own rows. Of an anchor the rows of at most two ids a batch go to the anchor's
partition, of an edge one row a batch (the smallest document); the others are settled in the batch and are dealt out at random.

Cases: a null or blank text has no words (n_words 0, hash of the empty text); texts shorter than a window lose nothing; a row without an
id loses nothing and is no source (ids that aren't numbers count as null by the cast to long, an error under ANSI rules); rows of one id
are told apart by their text, and neither is a source of the other; of equal texts all but the smallest id lose every word that a window
covers; two different windows with one hash would be seen as such by their digests and end the run with an error that asks for another
seed; pieces on a ring of pieces stay paths of their own; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import Table, WordHashes, cut, drop, mix64, release, rolling, tidy

ANCHOR = 6


def _anchors(hashes: np.ndarray, k: int) -> np.ndarray:
    """For each window of k words the smallest hash of its runs of ANCHOR words."""
    runs = rolling(hashes, min(ANCHOR, k))
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = runs[:n].copy()
    for i in range(1, len(runs) - n + 1):
        np.minimum(out, runs[i : i + n], out=out)
    return out


def _spread(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix64(x * np.uint64(0x9E3779B97F4A7C15) ^ mix64(y.astype(np.uint64)))


def _flat(sizes: list[int]) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def _split(text: pa.StringScalar) -> list[bytes]:
    held = text.as_buffer()
    return held.to_pybytes().split() if held is not None else []


def anchor_rows(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """key, anchor, doc_id, known: key is the anchor, or random where the batch itself shows that the anchor is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes(seed)
        for whole in batches:
            tidy()
            for first in range(0, whole.num_rows, 2000):
                b = whole.slice(first, 2000)
                # In order of ids, so that one stable sort by anchor leaves each anchor's ids in order.
                by_id = np.argsort(b.column(0).to_numpy(), kind="stable")
                texts = b.column(1)
                found = [np.unique(_anchors(cache.of(_split(texts[i])), k)) for i in by_id.tolist()]
                row = _flat(list(map(len, found)))
                if not len(row):
                    continue
                anchor, ids = np.concatenate(found), b.column(0).to_numpy()[by_id][row]
                order = np.argsort(anchor, kind="stable")
                held, owner = anchor[order], ids[order]
                same = held[1:] == held[:-1]
                start = np.flatnonzero(np.concatenate([[True], ~same]))
                # Which of the anchor's distinct ids a row has, from 0; rows of one id stay together, as they may be all that it has.
                step = np.concatenate([[False], (owner[1:] != owner[:-1]) & same]).cumsum()
                known = np.empty(len(held), bool)
                known[order] = step - np.repeat(step[start], np.diff(np.concatenate([start, [len(held)]]))) >= 2
                # Rows stay in order of documents, in which ids repeat from row to row and compress. What is known meets nothing: it is
                # dealt out by document.
                key = np.where(known, _spread(ids.view(np.uint64), row), anchor)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(anchor.view(np.int64)), pa.array(ids), pa.array(known)], ["key", "anchor", "doc_id", "known"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, anchor long, doc_id long, known boolean")


def edge_rows(marked: DataFrame, k: int, seed: int) -> DataFrame:
    """key, check, doc_id, print, at, source, source_print, source_at: an edge for each window with a repeated anchor; marked has anchors.

    The source is null unless the batch itself settles it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, again = WordHashes(seed), np.uint64(0xD6E8FEB86659FD93)
        for whole in batches:
            tidy()
            for first in range(0, whole.num_rows, 2000):
                b = whole.slice(first, 2000)
                by_id = np.argsort(b.column(0).to_numpy(), kind="stable")
                texts, marks = b.column(2), b.column(3)
                keys, checks, ats, sizes = [], [], [], []
                for i in by_id.tolist():
                    h = cache.of(_split(texts[i]))
                    at = np.flatnonzero(np.isin(_anchors(h, k), marks[i].values.to_numpy().view(np.uint64)))
                    keys.append(rolling(h, k)[at])
                    checks.append((rolling(h * again + np.uint64(1), k)[at] >> np.uint64(33)).astype(np.int32))
                    ats.append(at.astype(np.int32))
                    sizes.append(len(at))
                row = _flat(sizes)
                if not len(row):
                    continue
                key, check, at = np.concatenate(keys), np.concatenate(checks), np.concatenate(ats)
                ids, prints = b.column(0).to_numpy()[by_id][row], b.column(1).to_numpy()[by_id]
                # One stable sort: edges stay in order of (id, place). Two that clash in both hashes may only seem new.
                both = key ^ mix64(check.astype(np.uint64))
                order = np.argsort(both, kind="stable")
                k1, c1 = key[order], check[order]
                new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (c1[1:] != c1[:-1])])
                lead = np.empty(len(key), np.int64)
                lead[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
                known = ids > ids[lead]
                # What is settled meets nothing: it is dealt out by document, a few thousand words at a time, which also compresses.
                held = np.where(known, _spread(ids.view(np.uint64), at >> 12), key)
                check = np.where(known, 0, check).astype(np.int32)
                source, source_print, source_at = ids[lead], prints[row[lead]], at[lead]
                null = ~known
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(held.view(np.int64)), pa.array(check), pa.array(ids), pa.array(prints[row]), pa.array(at),
                        pa.array(source, mask=null), pa.array(source_print, mask=null), pa.array(source_at, mask=null),
                    ],
                    ["key", "check", "doc_id", "print", "at", "source", "source_print", "source_at"],
                )

    return marked.mapInArrow(run, "key long, check int, doc_id long, print long, at int, source long, source_print long, source_at int")


#: Ids that a broadcast may hold (8 bytes each); with more, texts are shuffled without being reduced first.
MOST_BROADCAST = 2_000_000


def with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (doc_id, print, ...) with their documents' texts. Where the ids are few, other texts are left out before the shuffle."""
    ids = rows.select("doc_id").distinct()
    if ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    texts = docs.select(F.col("doc_id").alias("id2"), F.col("print").alias("print2"), "text")
    return rows.join(texts, (F.col("doc_id") == F.col("id2")) & (F.col("print") == F.col("print2"))).drop("id2", "print2")


def _marks(docs: DataFrame, leaders: DataFrame, k: int, seed: int) -> DataFrame:
    """doc_id, print, marks: the repeated anchors of each leader. What is named here would keep the anchors' shuffle files."""
    # A key's rows are few (of two ids a batch at most), so a window over them needs no join, and one shuffle is all.
    by = W.partitionBy("key")
    counted = anchor_rows(docs, k, seed).select("doc_id", "anchor", F.min("doc_id").over(by).alias("lo"), F.max("doc_id").over(by).alias("hi"), F.max("known").over(by).alias("any"))
    hits = counted.where("lo < hi or any").select("doc_id", "anchor")
    return cut(hits.groupBy("doc_id").agg(F.collect_list("anchor").alias("marks")).join(leaders, "doc_id"), small=True)


def runs(docs: DataFrame, leaders: DataFrame, k: int, seed: int) -> DataFrame:
    """doc_id, print, start, stop, source, source_print, source_start: consecutive repeated edges of the leaders (doc_id, print), from
    position start up to but without stop, in step with consecutive edges of their source. docs has doc_id, print, text without nulls."""
    marks = _marks(docs, leaders, k, seed)
    release(docs.sparkSession)
    marked = with_text(marks, docs)
    edges = edge_rows(marked.select("doc_id", "print", "text", "marks"), k, seed)
    first = F.min(F.struct("doc_id", "print", "at")).over(W.partitionBy("key", "check"))
    own = F.col("source").isNotNull()
    met = edges.withColumn("first", first).where(own | (F.col("doc_id") > F.col("first.doc_id")))
    either = lambda x, y: F.when(own, F.col(x)).otherwise(F.col(f"first.{y}"))
    edge = met.select("doc_id", "print", "at", either("source", "doc_id").alias("source"), either("source_print", "print").alias("source_print"), either("source_at", "at").alias("s_at"))
    w = W.partitionBy("doc_id", "print").orderBy("at")
    same = [F.col(c) == F.lag(c).over(w) for c in ("source", "source_print")] + [F.col(c) == F.lag(c).over(w) + 1 for c in ("at", "s_at")]
    follows = same[0] & same[1] & same[2] & same[3]
    numbered = edge.withColumn("head", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("head").over(w.rowsBetween(W.unboundedPreceding, 0)))
    found = numbered.groupBy("doc_id", "print", "run").agg(
        F.min("at").alias("start"), (F.max("at") + 1).alias("stop"), F.min("source").alias("source"), F.min("source_print").alias("source_print"), F.min("s_at").alias("source_start")
    )
    out = cut(found.drop("run"))
    drop(marks)
    return out


#: Ranges of one source that a task reads at once; a source with more of them is read several times.
RANGES = 20_000
RUN, DIGEST, NODE = 0, 1, 2


def _digest(words_: list[bytes]) -> bytes:
    import hashlib

    return hashlib.blake2b(b" ".join(words_), digest_size=16).digest()


def source_rows(ranges: DataFrame, docs: DataFrame, k: int, seed: int) -> DataFrame:
    """What the texts of sources say about ranges (source, source_print, start, stop) of their edges, by kind: RUN, the union of ranges
    (start, stop); DIGEST, of a range's words; NODE, the node before edge ``start``, with 31 bits of the edges in and out of it (a clash
    would hide a branch, which only lengthens a path)."""
    many = ranges.groupBy("source", "source_print").agg(F.ceil(F.count(F.lit(1)) / RANGES).cast("int").alias("parts"))
    dealt = ranges.join(many, ["source", "source_print"]).withColumn("part", F.pmod(F.xxhash64("start", "stop"), F.col("parts")))
    rows = dealt.groupBy("source", "source_print", "part").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    rows = rows.select(F.col("source").alias("doc_id"), F.col("source_print").alias("print"), "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes(seed)
        for whole in batches:
            tidy()
            for i in range(whole.num_rows):
                doc_id, print_, text = (whole.column(c)[i].as_py() for c in range(3))
                pairs = whole.column(3)[i].values.flatten()
                starts, stops = (x.to_numpy() for x in pairs)
                found = text.encode().split()
                h = cache.of(found)
                edge, node = rolling(h, k).view(np.int64), rolling(h, k - 1).view(np.int64)
                depth = np.zeros(len(edge) + 1, np.int64)
                np.add.at(depth, starts, 1)
                np.add.at(depth, stops, -1)
                inside = np.concatenate([[False], depth.cumsum()[:-1] > 0, [False]])
                flips = np.flatnonzero(inside[1:] != inside[:-1])
                first, last = flips[::2], flips[1::2]
                at = np.concatenate([np.arange(a, b + 1) for a, b in zip(first.tolist(), last.tolist(), strict=True)])
                # inside[p + 1] tells whether edge p is in a range, inside[p] whether the one before is.
                n, r = len(at), (len(first), len(starts))
                kinds = np.repeat([RUN, DIGEST, NODE], [*r, n]).astype(np.int32)
                none = np.zeros(sum(r), np.int64)
                some = np.concatenate([np.ones(sum(r), bool), np.zeros(n, bool)])
                into = np.where(inside[at], edge[at - 1] & 0x7FFFFFFF, 0).astype(np.int32), ~inside[at]
                out = np.where(inside[at + 1], edge[np.minimum(at, len(edge) - 1)] & 0x7FFFFFFF, 0).astype(np.int32), ~inside[at + 1]
                digests = [None] * r[0] + [_digest(found[a : b + k - 1]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)] + [None] * n
                held = lambda x, mask: pa.array(np.concatenate([none.astype(np.int32), x]), mask=np.concatenate([np.ones(len(none), bool), mask]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(kinds), pa.array(np.full(len(kinds), doc_id, np.int64)), pa.array(np.full(len(kinds), print_, np.int64)),
                        pa.array(np.concatenate([first, starts, at]).astype(np.int32)), pa.array(np.concatenate([last, stops, at]).astype(np.int32)),
                        pa.array(np.concatenate([none, node[at]]), mask=some), held(*into), held(*out), pa.array(digests, pa.binary()),
                    ],
                    ["kind", "source", "source_print", "start", "stop", "node", "into", "out", "digest"],
                )

    texts = with_text(rows, docs).select("doc_id", "print", "text", "ranges")
    return texts.mapInArrow(run, "kind int, source long, source_print long, start int, stop int, node long, into int, out int, digest binary")


_SOURCE = ["source", "source_print"]


def joints(nodes: DataFrame) -> DataFrame:
    """source, source_print, at, onto: where a path ends at a node. onto is null at a branch; else it is the place (source,
    source_print, start) of another source at which the only edge out of the node starts."""
    by = W.partitionBy("node")
    branch = (F.min("into").over(by) != F.max("into").over(by)) | (F.min("out").over(by) != F.max("out").over(by))
    starts = F.when(F.col("into").isNull() & F.col("out").isNotNull(), F.struct(*_SOURCE, "start"))
    seen = nodes.select(*_SOURCE, F.col("start").alias("at"), "into", "out", F.coalesce(branch, F.lit(False)).alias("branch"), F.min(starts).over(by).alias("onto"))
    inner = F.col("into").isNotNull() & F.col("out").isNotNull()
    goes_on = F.col("into").isNotNull() & F.col("out").isNull() & F.col("onto").isNotNull()
    return seen.where((F.col("branch") & inner) | (~F.col("branch") & goes_on)).select(*_SOURCE, "at", F.when(~F.col("branch"), F.col("onto")).alias("onto"))


def paths(source_runs: DataFrame, ends: DataFrame) -> DataFrame:
    """source, source_print, start, stop, path, hop: pieces of sources' runs between branches; path is the first piece of the contracted
    path, hop the piece's number on it."""
    w = W.partitionBy(*_SOURCE).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    merged = source_runs.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("n", F.sum("new").over(w))
    merged = merged.groupBy(*_SOURCE, "n").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    # At most as many branches as the source has words.
    cuts = ends.where("onto is null").groupBy(*_SOURCE).agg(F.sort_array(F.collect_set("at")).alias("cuts"))
    inside = F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda x: (x > F.col("start")) & (x < F.col("stop")))
    bounds = merged.join(cuts, _SOURCE, "left").select(*_SOURCE, F.concat(F.array("start"), inside, F.array("stop")).alias("b"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("b") - 1), lambda i: F.struct(F.get("b", i - 1).alias("start"), F.get("b", i).alias("stop")))
    pieces = cut(bounds.select(*_SOURCE, F.explode(pairs).alias("p")).select(*_SOURCE, "p.start", "p.stop"), small=True)
    name = F.struct(*_SOURCE, "start")
    links = ends.where("onto is not null").select(*_SOURCE, F.col("at").alias("stop"), "onto").join(pieces, [*_SOURCE, "stop"])
    links = links.select(name.alias("head"), F.col("onto").alias("piece")).where("head <> piece").groupBy("piece").agg(F.min("head").alias("head"))
    heads = cut(links.select("piece", "head", F.lit(1).cast("long").alias("hop")), light=True)
    n, doubled = heads.count(), 1
    while n and doubled <= 2 * n:
        up = heads.select(F.col("piece").alias("head"), F.col("head").alias("next"), F.col("hop").alias("more"))
        step = cut(heads.join(up, "head", "left").select("piece", F.coalesce("next", "head").alias("head"), (F.col("hop") + F.coalesce("more", F.lit(0))).alias("hop"), F.col("next").isNotNull().alias("moved")), light=True)
        drop(heads)
        heads, doubled = step, 2 * doubled
        if step.where("moved").isEmpty():
            break
    # A head that still has one before it lies on a ring.
    ring = heads.select(F.col("piece").alias("head"), F.lit(True).alias("ring"))
    heads = heads.select("piece", "head", "hop").join(ring, "head", "left").where("ring is null").select(F.col("piece").alias("path_of"), "head", "hop")
    named = pieces.withColumn("path_of", name).join(heads, "path_of", "left")
    return named.select(*_SOURCE, "start", "stop", F.coalesce("head", "path_of").alias("path"), F.coalesce("hop", F.lit(0)).alias("hop"))


def repeated_spans(docs: DataFrame, leaders: DataFrame, k: int = 13, seed: int = 0) -> tuple[DataFrame, DataFrame, Callable[[], None]]:
    """Spans: doc_id, print, start, end (in words), source, source_print, source_start, path, hop, the parts of contracted paths in the
    leaders (doc_id, print). Checks: doc_id, print, start, end, digest of the source's words that each run repeats. And a function that
    deletes what both are read from, to be called when they have been used.

    docs has doc_id, print and text, without nulls."""
    found = runs(docs, leaders, k, seed)
    length = F.col("stop") - F.col("start")
    ranges = found.select(*_SOURCE, F.col("source_start").alias("start"), (F.col("source_start") + length).alias("stop")).distinct()
    release(docs.sparkSession)
    table = Table(source_rows(ranges, docs, k, seed), "sources")
    seen = table.df
    ends = cut(joints(seen.where(f"kind = {NODE}")), let_go=True, small=True)
    pieces = paths(seen.where(f"kind = {RUN}").select(*_SOURCE, "start", "stop"), ends).select(*_SOURCE, F.col("start").alias("p0"), F.col("stop").alias("p1"), "path", "hop")
    met = found.withColumn("s1", F.col("source_start") + length).join(pieces, _SOURCE).where("p0 < s1 and source_start < p1")
    lo, hi = F.greatest("p0", "source_start"), F.least("p1", "s1")
    shift = F.col("start") - F.col("source_start")
    spans = met.select("doc_id", "print", (lo + shift).alias("start"), (hi + shift + (k - 1)).alias("end"), *_SOURCE, lo.alias("source_start"), "path", "hop")
    digests = seen.where(f"kind = {DIGEST}").select(*_SOURCE, F.col("start").alias("source_start"), F.col("stop").alias("s1"), "digest")
    checks = found.withColumn("s1", F.col("source_start") + length).join(digests, [*_SOURCE, "source_start", "s1"])
    checks = checks.select("doc_id", "print", "start", (F.col("stop") + (k - 1)).alias("end"), "digest")

    def spent() -> None:
        drop(found, ends)
        table.drop()

    return spans, checks, spent


def _finish(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 from doc_id, text, spans, checks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for whole in batches:
            tidy()
            for first in range(0, whole.num_rows, 500):
                b = whole.slice(first, 500)
                n, gone, sha = [], [], []
                for text, spans, checks in zip(b.column(1), b.column(2), b.column(3), strict=True):
                    found = text.as_py().encode().split()
                    for c in checks.as_py():
                        if _digest(found[c["start"] : c["end"]]) != c["digest"]:
                            raise ValueError("two different windows have one hash: run again with another seed")
                    keep = np.ones(len(found), bool)
                    for s in spans.as_py():
                        keep[s["start"] : s["end"]] = False
                    left = [w for w, x in zip(found, keep.tolist(), strict=True) if x]
                    n.append(len(found))
                    gone.append(len(found) - len(left))
                    sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, k: int = 13, seed: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row for each input row."""
    body = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(body, F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))
    # Words joined by one space: only white space other than one space is a match, and few texts have much of it.
    plain = rows.withColumn("plain", F.btrim(F.regexp_replace("text", r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "), F.lit(" ")))
    n_words = F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1)
    facts = cut(plain.select("doc_id", "print", F.xxhash64(F.lit("again"), "text").alias("print2"), n_words.cast("long").alias("n_words"), F.sha2("plain", 256).alias("sha")))
    # Of equal texts only the smallest id goes on to the graph: all windows of the others are in it.
    lead = facts.where("doc_id is not null").groupBy("print", "print2").agg(F.min("doc_id").alias("lead"))
    state = cut(
        facts.join(lead, ["print", "print2"], "left").select(
            "doc_id", "print", "n_words", "sha", F.coalesce((F.col("doc_id") > F.col("lead")) & (F.col("n_words") >= k), F.lit(False)).alias("copy")
        ),
        small=True,
    )
    graph = rows.where("doc_id is not null").select("doc_id", "print", "text")
    leaders = state.where(f"not copy and n_words >= {k} and doc_id is not null").select("doc_id", "print").distinct()
    spans, checks, spent = repeated_spans(graph, leaders, k, seed)
    # At most as many of either as the document has words.
    by_doc = spans.groupBy("doc_id", "print").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    by_doc = cut(by_doc.join(checks.groupBy("doc_id", "print").agg(F.collect_list(F.struct("start", "end", "digest")).alias("checks")), ["doc_id", "print"]), small=True)
    spent()
    release(docs.sparkSession)
    touched = with_text(by_doc, graph)
    changed = _finish(touched.select("doc_id", "text", "spans", "checks"))
    empty = F.sha2(F.lit(""), 256)
    rest = state.join(by_doc.select("doc_id", "print"), ["doc_id", "print"], "left_anti")
    rest = rest.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("copy"), empty).otherwise(F.col("sha")).alias("kept_sha256"))
    return rest.unionByName(changed)
