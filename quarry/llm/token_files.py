"""Token-id files of directly addressable codes: any token can be read without decoding a block.

An id is split into chunks of given widths (8, 8 and 16 bits). Level 0 has the low chunk of every id; a bitmap tells which ids go on,
and level 1 has the next chunk of just those, and so on. A directory of ranks (how many bits are set before each block of 512)
finds an id's chunk in the next level, so access costs a few look-ups.

A table of segments is the stored form: Spark writes and commits it to any file system that it reaches. Each row holds one
self-describing file image: header, directory of documents (id, start, length), then the levels. Segments hold whole documents in
ascending order of doc_id, and ``part``, ``segment`` and ``part_start`` order them.

Cases: a null text is empty and still gets its end id; null doc_ids come first; repeated ids keep a row each, ordered by text; ids that aren't
numbers are null by the cast to long (an error under ANSI rules); an empty table writes no segment and reads as no rows; other columns aren't read. A document of any length fits: a segment ends only
between documents.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import held, shared_path
from quarry.llm.pieces import ChunkCache

VOCABULARY = "byte_bpe_50k.json"
MAGIC = b"DAC1"
WIDTHS = (8, 8, 16)
BLOCK = 512


def pack(ids: np.ndarray) -> bytes:
    """Ids below 2**32 as levels of chunks with bitmaps and rank directories."""
    left = np.ascontiguousarray(ids, dtype=np.uint32)
    out = [MAGIC, struct.pack("<B", len(WIDTHS)), struct.pack("<Q", len(left))]
    for i, width in enumerate(WIDTHS):
        chunk = (left & np.uint32((1 << width) - 1)).astype("<u1" if width == 8 else "<u2")
        rest = left >> np.uint32(width) if i + 1 < len(WIDTHS) else np.zeros(len(left), np.uint32)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), BLOCK)) if len(more) else np.empty(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per_block, dtype=np.uint64)]).astype("<u4")
        out += [struct.pack("<BQQQ", width, chunk.nbytes, bits.nbytes, ranks.nbytes), chunk.tobytes(), bits.tobytes(), ranks.tobytes()]
        left = rest[more]
    return b"".join(out)


class Codes:
    """Reads packed ids in place."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        (levels,), (self.n,) = struct.unpack_from("<B", data, 4), struct.unpack_from("<Q", data, 5)
        self.levels, at = [], 13
        for _ in range(levels):
            width, c, b, r = struct.unpack_from("<BQQQ", data, at)
            at += 25
            chunk = np.frombuffer(data[at : at + c], "<u1" if width == 8 else "<u2")
            bits = np.frombuffer(data[at + c : at + c + b], np.uint8)
            ranks = np.frombuffer(data[at + c + b : at + c + b + r], "<u4")
            self.levels.append((width, chunk, bits, ranks))
            at += c + b + r

    def __len__(self) -> int:
        return self.n

    @staticmethod
    def rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """How many bits are set before i."""
        block = i // BLOCK
        first, whole, rest = block * BLOCK // 8, i // 8, i % 8
        n = int(ranks[block]) + int(np.bitwise_count(bits[first:whole]).sum())
        return n + ((int(bits[whole]) & ((1 << rest) - 1)).bit_count() if rest else 0)

    def __getitem__(self, i: int) -> int:
        """One id, by a rank on each level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for width, chunk, bits, ranks in self.levels:
            value |= int(chunk[i]) << shift
            shift += width
            if not (int(bits[i // 8]) >> (i % 8)) & 1:
                break
            i = self.rank(bits, ranks, i)
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end: one rank on each level, then whole runs."""
        out = np.zeros(end - start, np.uint32)
        where, shift = None, 0
        for width, chunk, bits, ranks in self.levels:
            if end <= start:
                break
            part = chunk[start:end].astype(np.uint32) << np.uint32(shift)
            if where is None:
                out |= part
            else:
                out[where] |= part
            shift += width
            first = start // 8
            more = np.unpackbits(bits[first : (end + 7) // 8], bitorder="little")[start - 8 * first : end - 8 * first].view(bool)
            n = int(np.count_nonzero(more))
            where = np.flatnonzero(more) if where is None else where[more]
            start = self.rank(bits, ranks, start) if n else 0
            end = start + n
        return out


def byte_characters() -> dict[int, int]:
    """The character that a byte-level vocabulary shows a byte as: itself if it can be seen, else the next from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: b if b in seen else next(hidden) for b in range(256)}


class Encoder:
    """The public tokenizers library, asked once for each chunk of text that was not met lately."""

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        if not path:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        split, tokenize = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        table = byte_characters()

        def word(text: str) -> bytes:
            return array("I", [t.id for t in tokenize(text.encode().decode("latin-1").translate(table))]).tobytes()

        self.chunks = ChunkCache(lambda text: array("I", [t.id for piece, _ in split(text) for t in tokenize(piece)]).tobytes(), word)

    @classmethod
    def get(cls, path: str | None) -> Encoder:
        return held("token_files", path, lambda: cls(path))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.chunks.of(text)


SEGMENT = "part int, segment int, part_start long, n_docs int, n_tokens long, image binary"


def _image(doc_ids: list[int | None], sizes: list[int], data: bytes) -> bytes:
    """A segment's file image: documents, then codes."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    return struct.pack("<Q", len(sizes)) + known.tobytes() + ids.tobytes() + np.array(sizes, "<u8").tobytes() + pack(np.frombuffer(data, "<u4"))


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    """Document ids, their lengths, and the codes."""
    view = memoryview(image)
    (n,) = struct.unpack_from("<Q", view, 0)
    known = np.frombuffer(view[8 : 8 + n], np.uint8)
    ids = np.frombuffer(view[8 + n : 8 + 9 * n], "<i8").tolist()
    sizes = np.frombuffer(view[8 + 9 * n : 8 + 17 * n], "<u8").astype(np.int64)
    return [d if k else None for d, k in zip(ids, known.tolist(), strict=True)], sizes, Codes(view[8 + 17 * n :])


def write(docs: DataFrame, path: str, end_id: int = 0, segment_tokens: int = 1_000_000, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode all texts and write the segments in ascending order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = Encoder.get(tokenizer), TaskContext.get().partitionId()
        end = array("I", [end_id]).tobytes()
        ids, sizes, held, segment, start, total = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, sizes, held, segment, start, total
            row = [part, segment, start, len(sizes), total, _image(ids, sizes, b"".join(held))]
            ids, sizes, held, segment, start, total = [], [], [], segment + 1, start + total, 0
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["part", "segment", "part_start", "n_docs", "n_tokens", "image"])

        for b in batches:
            for i, d in enumerate(b.column(0).to_pylist()):
                data = encoder.encode(b.column(1)[i].as_py() or "") + end
                ids.append(d)
                sizes.append(len(data) // 4)
                held.append(data)
                total += len(data) // 4
                if total >= segment_tokens:
                    yield flush()
        if sizes:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SEGMENT).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document in the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    segments = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, sizes, codes = read_image(b.column(2)[i].as_py())
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crcs = [zlib.crc32(codes.slice(s, e).astype("<u4").tobytes()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n, first = len(ids), b.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[i].as_py()] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(starts + first, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    found = segments.select("part", "part_start", "image").mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # A row a written part: as many as that job had tasks, whatever the size of the input.
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return found.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, **options) -> DataFrame:
    """Write to a fresh place in the shared folder and read back."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-ids")
    write(docs, path, **options)
    return read(spark, path)
