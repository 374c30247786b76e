"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Encoding.  A path of the nondeterministic machine reads a piece's bytes down the vocabulary's trie; where they complete a token that may
follow the path's last one, a path that took it starts at the root again. A token b may follow a only if the merges leave the pair as it
is, that is, if the bytes of a and b together encode to just [a, b]. Of all paths that spell a piece exactly one keeps this rule
throughout, and it is the canonical encoding. A deterministic state is the set of paths that are alive, less the tokens that all of them hold first:
those are emitted, after a lookahead that the longest token bounds. States and transitions are made when first met, one a piece, and kept in a bounded
table, as are the answers of which token may follow which.

Decoding.  Ids become bytes; a small UTF-8 state machine holds back an incomplete character until the ids that end it arrive.

Cases: a null or empty text encodes to no ids and decodes to no bytes; ids outside of the vocabulary raise; bytes that are not
UTF-8 decode with U+FFFD in text, and stay as they are in bytes.  Rows stay one to one with the input: repeated rows, null ids
and ties need no rule, and columns other than the id and the text aren't read.  An empty table gives an empty table.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held, small_batches, tidy
from quarry.llm.pieces import ChunkCache

VOCABULARY = "byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def vocabulary_path(path: str | None) -> str:
    """The rank file: a given path, or the installed public one (looked up on the machine that reads it)."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Transducer:
    """A lazily determinised transducer from the bytes of a piece (a match of the splitting pattern) to its ids.

    A path of the nondeterministic machine is (last, held, node): the token it ended with, its tokens that aren't emitted yet, and the
    node of the vocabulary's trie that the bytes after them have reached. A byte moves each path down the trie; where that completes
    a token that may follow ``last``, a path that took it starts at the root again. A deterministic state is the set of paths that
    are alive, less the tokens that all of them hold first: those are emitted. States and transitions are made when first met, one a piece."""

    def __init__(self, ranks: dict[bytes, int], most: int = 120_000):
        self.ranks, self.most = ranks, most
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.follows: dict[int, bool] = {}  # by a * 2**32 + b
        # The trie: a node's child by node * 256 + byte, whether it has any, and the token that ends at it (-1: none).
        self.child: dict[int, int] = {}
        self.token = array("i", [-1])
        for t, i in ranks.items():
            node = 0
            for byte in t:
                nxt = self.child.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.child[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        self.inner = bytearray(len(self.token))
        for key in self.child:
            self.inner[key >> 8] = 1
        self._forget()

    def _forget(self) -> None:
        self.number: dict[tuple, int] = {}
        self.paths: list[tuple] = []
        #: state * 256 + byte -> next state, or its complement if ids are emitted; and those ids.
        self.step: dict[int, int] = {}
        self.emitted: dict[int, tuple[int, ...]] = {}
        self.missed = 0
        self._state(((-1, (), 0),))

    def _state(self, paths: tuple) -> int:
        n = self.number.get(paths)
        if n is None:
            n = self.number[paths] = len(self.paths)
            self.paths.append(paths)
        return n

    def merge(self, data: bytes, below: int | None = None) -> list[int]:
        """Merging by rank, lowest first and leftmost of equals: the definition that the transducer must agree with."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge into this one; None for a single byte."""
        if token not in self.parts:
            data = self.bytes_of[token]
            got = self.merge(data, token) if len(data) > 1 else [token]
            if len(got) > 2:
                raise ValueError("the vocabulary isn't made of merges")
            self.parts[token] = (got[0], got[1]) if len(got) == 2 else None
        return self.parts[token]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b side by side as they are (a is -1 at the start).

        Undone from the latest merge backwards, the two tokens show what stood at their border at each time. A merge across the border
        would have been made if it ranks before the next merge that changes a side: on the left with the same rank it goes first."""
        if a < 0:
            return True
        known = self.follows.get(a << 32 | b)
        if known is None:
            if len(self.follows) > self.most:
                self.follows.clear()
            x, y, before, ranks, data = a, b, None, self.ranks, self.bytes_of
            while True:
                r = ranks.get(data[x] + data[y])
                if r is not None and (before is None or r < before):
                    known = False
                    break
                left, right = self.halves(x), self.halves(y)
                if left is None and right is None:
                    known = True
                    break
                # Of the two last merges the later one is undone; of equal ones the right, as the leftmost went first.
                if right is None or (left is not None and x > y):
                    before, x = x, left[1]
                else:
                    before, y = y + 1, right[0]
            self.follows[a << 32 | b] = known
        return known

    def advance(self, paths: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The paths alive after a byte, less the ids that all of them hold first, and those ids."""
        child, inner, token, follows, alive, whole = self.child, self.inner, self.token, self.follows, [], None
        for last, held, node in paths:  # those that hold the longest part of a token come first
            key = node << 8 | byte
            if key not in child:
                continue
            nxt = child[key]
            if inner[nxt]:
                alive.append((last, held, nxt))
            if whole is None:
                t = token[nxt]
                # What was read so far has one encoding, so that no second path can end here.
                if t >= 0:
                    fits = True if last < 0 else follows.get(last << 32 | t)
                    if fits or (fits is None and self.may_follow(last, t)):
                        whole = t, (*held, t), 0
        if whole is None:
            raise ValueError("the vocabulary lacks a single byte or isn't made of merges")
        alive.append(whole)
        first = alive[0][1]
        if first:
            n = len(first)
            for _, h, _ in alive:
                while h[:n] != first[:n]:
                    n -= 1
            if n:
                return tuple([(last, h[n:], node) for last, h, node in alive]), first[:n]
        return tuple(alive), ()

    def grow(self, state: int, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The transition of a state on a byte, made when first asked for; the paths of the state that it leads to, and the ids.

        A full table grows no more: what came first is what texts repeat most. After many misses it starts anew, as texts change."""
        paths, ids = self.advance(self.paths[state], byte)
        if len(self.step) < self.most:
            key, out = state << 8 | byte, self._state(paths)
            self.step[key] = ~out if ids else out
            if ids:
                self.emitted[key] = ids
        else:
            self.missed += 1
            if self.missed > 64 * self.most:
                self._forget()
        return paths, ids

    def start(self) -> Run:
        return Run(self)

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece. As in the public library, a piece that is itself a token is that token."""
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        run = Run(self)
        return run.feed(piece) + run.end()


class Run:
    """A transducer at work on one piece, fed in parts: ids leave as soon as no path that is alive disagrees.

    Transitions that are known are followed. The first that isn't is made, and from there on the paths are followed as a set up to the
    piece's end, so that a piece adds one state at most and the table holds what texts repeat."""

    def __init__(self, fst: Transducer):
        self.fst, self.state, self.paths = fst, 0, None

    def feed(self, data: bytes) -> list[int]:
        fst, state, out, at = self.fst, self.state, [], 0
        if self.paths is None:
            step, emitted = fst.step, fst.emitted
            for byte in data:
                key = state << 8 | byte
                known = step.get(key)
                if known is None:
                    break
                at += 1
                if known < 0:
                    out += emitted[key]
                    state = ~known
                else:
                    state = known
            else:
                self.state = state
                return out
            self.paths, ids = fst.grow(state, data[at])
            out += ids
            at += 1
        paths, advance = self.paths, fst.advance
        for byte in data[at:]:
            paths, ids = advance(paths, byte)
            if ids:
                out += ids
        self.paths = paths
        return out

    def held(self) -> list[int]:
        """The ids that the whole input so far would end with beyond those emitted."""
        return list((self.fst.paths[self.state] if self.paths is None else self.paths)[-1][1])

    def end(self) -> list[int]:
        out = self.held()
        self.state, self.paths = 0, None
        return out


class Utf8Machine:
    """Incremental UTF-8: tells how many of the bytes so far make whole characters."""

    @staticmethod
    def whole(data: bytes) -> int:
        """The length of data without an incomplete character at its end."""
        n = len(data)
        for back in range(1, min(4, n + 1)):
            b = data[n - back]
            if b < 0x80:
                return n
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF8 else 1
                return n if need <= back else n - back
        return n


class StreamDecoder:
    """Ids in, text out as soon as its characters are whole."""

    def __init__(self, tokens: list[bytes | None]):
        self.tokens, self.tail = tokens, b""

    def raw(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def feed(self, ids: Iterable[int]) -> str:
        data = self.tail + self.raw(ids)
        n = Utf8Machine.whole(data)
        self.tail = data[n:]
        return data[:n].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.tail = self.tail.decode("utf-8", "replace"), b""
        return out


class Tokens:
    """The bytes of each id, for decoding alone."""

    @staticmethod
    def read(path: str | None) -> list[bytes | None]:
        bytes_of = {i: t for t, i in read_ranks(vocabulary_path(path)).items()}
        return [bytes_of.get(i) for i in range(max(bytes_of, default=-1) + 1)]

    @classmethod
    def get(cls, path: str | None) -> list[bytes | None]:
        return held("bpe", ("tokens", path), lambda: cls.read(path))


class Codec:
    """What a Python worker keeps to encode: the transducer and the chunk cache of a vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.fst = Transducer(read_ranks(path))
        find, encode = regex.compile(pattern).findall, self.fst.encode
        self.dtype = np.dtype("<u4") if max(self.fst.bytes_of, default=0) >= 65_536 else np.dtype("<u2")
        typecode = "H" if self.dtype.itemsize == 2 else "I"

        def chunk(text: str) -> bytes:
            ids: list[int] = []
            for piece in find(text):
                ids += encode(piece.encode("utf-8", "replace"))
            return array(typecode, ids).tobytes()

        self.chunks = ChunkCache(chunk, lambda word: array(typecode, encode(word.encode())).tobytes(), most=250_000)

    @classmethod
    def get(cls, path: str | None, pattern: str | None) -> Codec:
        def make() -> Codec:
            import public_tokenizers

            return cls(vocabulary_path(path), pattern or public_tokenizers.PATTERN)

        return held("bpe", (path, pattern), make)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.chunks.of(text), self.dtype)


def _encoded(texts: pa.Array, codec: Codec) -> pa.ListArray:
    found = [codec.encode(x.as_py() or "") for x in texts]
    offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)))


def _decoded(ids: pa.ListArray, tokens: list[bytes | None], as_text: bool, window: int = 65_536) -> pa.Array:
    """Ids go through the streaming decoder a window at a time."""
    flat, offsets = ids.flatten().to_numpy(zero_copy_only=False), np.asarray(ids.offsets)
    out, first = [], offsets[0]
    for start, end in zip((offsets[:-1] - first).tolist(), (offsets[1:] - first).tolist(), strict=True):
        stream = StreamDecoder(tokens)
        text = "".join([stream.feed(flat[k : min(k + window, end)].tolist()) for k in range(start, end, window)])
        if as_text:
            out.append(text + stream.end())
        else:  # a mark may stand for bytes that are no UTF-8
            out.append(text.encode() + stream.tail if "\ufffd" not in text else stream.raw(flat[start:end].tolist()))
    return pa.array(out, pa.string() if as_text else pa.binary())


def encoder(path: str | None = None, pattern: str | None = None) -> Callable[[Column], Column]:
    """A function from a text column to ids array<int>."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec.get(path, pattern)
        for b in batches:
            yield _encoded(b, codec)

    small_batches()
    return F.arrow_udf(run, "array<int>").asNondeterministic()


def decoder(path: str | None = None, as_text: bool = False) -> Callable[[Column], Column]:
    """A function from ids to their bytes, or to text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = Tokens.get(path)
        for b in batches:
            yield _decoded(b, tokens, as_text)

    small_batches()
    return F.arrow_udf(run, "string" if as_text else "binary").asNondeterministic()


def coder(path: str | None = None, pattern: str | None = None) -> Callable[[Column], Column]:
    """A function from a text column to struct(ids, decoded): encoded and decoded by one Python worker, so that one vocabulary a core is
    in memory. Decoding sees the ids alone."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec, tokens = Codec.get(path, pattern), Tokens.get(path)
        for n, whole in enumerate(batches):
            if n % 16 == 0:
                tidy()
            parts = []
            for i in range(0, len(whole), 1000):
                ids = _encoded(whole.slice(i, 1000), codec)
                parts.append(pa.StructArray.from_arrays([ids, _decoded(ids, tokens, False)], ["ids", "decoded"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]))

    small_batches()
    return F.arrow_udf(run, "struct<ids:array<int>,decoded:binary>").asNondeterministic()


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids`` array<int>, for each row."""
    found = docs.select(F.struct(*keep).alias("row"), encoder(path, pattern)(F.col(text).cast("string")).alias("ids"))
    return found.select(*(F.col("row")[c].alias(c) for c in keep), "ids")


def decode(encoded: DataFrame, path: str | None = None, as_text: bool = False) -> DataFrame:
    """All columns, and ``decoded`` (bytes), or ``decoded_text`` if ``as_text``."""
    return encoded.withColumn("decoded_text" if as_text else "decoded", decoder(path, as_text)(F.col("ids")))


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``ids`` and ``decoded`` (the bytes that the ids decode to)."""
    found = docs.select(F.struct(*keep).alias("row"), coder(path, pattern)(F.col(text).cast("string")).alias("found"))
    return found.select(*(F.col("row")[c].alias(c) for c in keep), "found.ids", "found.decoded")


def digests(decoded: DataFrame) -> DataFrame:
    """The digest columns of the query, from the ids and the decoded bytes."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
