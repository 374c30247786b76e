"""Byte-level BPE over a lexicon of frequent words: a minimal acyclic transducer, memory-mapped, and exact merging for all other words.

Lexicon.  Spark counts the words of all texts; the most frequent ones, at most ``size`` by their counts, are encoded once and compiled
into the smallest acyclic automaton that reads their bytes: words share their beginnings and, as equal states are one, their endings.
Ids stand on its arcs as early as all words beyond an arc agree on them. It is built from the sorted words one by one: what the last word
has beyond the common prefix is final and is looked up among the states that exist. The image (a hash table of arcs, ids that states end
with, a pool of id sequences) is a file that Spark ships once to each executor; workers map it into memory and share its pages.

Encoding.  A text is cut into chunks (a space and what follows up to white space) whose encodings are independent. The distinct chunks of
some texts walk through the automaton together, a byte of each at a time. Chunks that it doesn't hold are split to pieces by the
tokenizer's own pattern, and their merges are done together too: in each round every piece merges its pair of lowest rank, leftmost first, which
is what the library does one by one. Pieces of more than ``LONG`` bytes take a heap. So the lexicon changes the time, never the ids.

Decoding.  Ids become bytes, bytes that are no UTF-8 become U+FFFD as in the library.

Cases: a null or empty text has no ids and decodes to an empty text; strings of added tokens in a text become their ids; repeated rows and null ids
of documents give a row each, as the input; other columns aren't read; an empty table gives an empty table. A tokenizer file with
another model, normalizer or splitter than byte-level BPE has raises. A word longer than ``LONGEST`` bytes is never in the lexicon.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import Table, held, shared_path, tidy
from quarry.llm.pieces import _ANY, _MARKS, plain

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of a word that the lexicon may hold; bytes from which on a piece is merged by itself; bytes of texts encoded at once.
LONGEST, LONG, GROUP_BYTES = 32, 256, 3_000_000
_NONE = np.int32(2**31 - 1)
_LATIN = re.compile("(?: [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+[.,;:!?]?)$").match


class Hash:
    """A table from numbers (not negative) to numbers as flat arrays that a file can hold: open addressing, whole arrays of keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, probes: int):
        self.keys, self.values, self.probes, self.mask = keys, values, probes, len(keys) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(32)) & np.uint64(self.mask)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Hash:
        """keys must differ."""
        size = 1 << max(4, (2 * len(keys)).bit_length())
        out = cls(np.full(size, -1, np.int64), np.zeros(size, np.int64), 0)
        left, slot = np.arange(len(keys)), out._slot(keys)
        while len(left):
            out.probes += 1
            free = out.keys[slot] < 0
            out.keys[slot[free]] = keys[left[free]]  # of several for one slot, the last stays
            won = out.keys[slot] == keys[left]
            out.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & out.mask
        return out

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        out = np.full(len(keys), default, np.int64)
        live, slot = np.arange(len(keys)), self._slot(keys)
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == keys[live]
            out[live[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            if not on.any():
                break
            live, slot = live[on], (slot[on] + 1) & self.mask
        return out


def byte_characters() -> dict[int, int]:
    """The character that a byte-level vocabulary shows a byte as: itself if it can be seen, else the next from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: b if b in seen else next(hidden) for b in range(256)}


class Merges:
    """A tokenizer file: the bytes of each id, merges by rank, added tokens and the splitting pattern."""

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        if not path:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, splitter, added = made["model"], made["pre_tokenizer"] or {}, made["added_tokens"]
        usual = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not usual or made["normalizer"] or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
            raise ValueError("not a tokenizer of byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take white space or words along aren't known")
        shown, vocab = byte_characters(), model["vocab"]
        back = {c: b for b, c in shown.items()}
        self.bytes_of: list[bytes | None] = [None] * (max([*vocab.values(), *(t["id"] for t in added)]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[ord(c)] for c in token)
        for t in added:
            self.bytes_of[t["id"]] = t["content"].encode()
        self.added = {t["content"]: t["id"] for t in added}
        self.find_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.byte_id = np.array([vocab[chr(shown[b])] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranked = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        self.ranks = Hash.of(np.array([a << 32 | b for a, b in self.ranked], np.int64), np.array([r for r, _ in self.ranked.values()], np.int64))
        every = np.arange(65_536)
        self.of_bytes = self.ranks.get(self.byte_id[every >> 8].astype(np.int64) << 32 | self.byte_id[every & 255], int(_NONE)).astype(np.int32)
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The matches of the splitting pattern in each text, in a row, and how many each has (a text isn't empty)."""
        out: list[list[str] | None] = []
        lines = []
        for t in texts:
            if _LATIN(t):  # a space and Latin letters are one match, a mark after them another
                out.append([t] if t[-1] not in _MARKS else [t[:-1], t[-1]])
            elif t[0] == " " and t[1:].split() == [t[1:]]:
                lines.append(len(out))
                out.append(None)
            else:
                out.append([t[a:b] for _, (a, b) in self.split(t)])
        # A line feed between two of " word" is a match of its own, so that many are split in one call.
        joined, part, k = "\n".join([texts[i] for i in lines]), [], 0
        for _, (a, b) in self.split(joined) if lines else ():
            if joined[a] == "\n":
                out[lines[k]], part, k = part, [], k + 1
            else:
                part.append(joined[a:b])
        if lines:
            out[lines[k]] = part
        return [p for found in out for p in found], np.fromiter(map(len, out), np.int64, len(out))

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece, by a heap of pairs over a linked list: n log n."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n, ranked = len(ids), self.ranked
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*r, i, p) for i, p in enumerate(pairwise(ids)) if (r := ranked.get(p))]
        heap = [(rank, i, p, new) for rank, new, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b), new = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranked.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, (ids[x], ids[y]), r[1]))
        return [x for x in ids if x >= 0]

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has."""
        raw = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        count, done = np.zeros(len(raw), np.int64), []
        for k in np.flatnonzero(sizes > LONG).tolist():
            ids = np.array(self.merge_long(raw[k]), np.int32)
            count[k], raw[k] = len(ids), b""
            done.append((np.full(len(ids), k, np.int32), ids))
        data, of = np.frombuffer(b"".join(raw), np.uint8), np.repeat(np.arange(len(raw), dtype=np.int32), np.where(sizes > LONG, 0, sizes))
        ids, rank = self.byte_id[data], np.full(len(data), _NONE)
        rank[:-1] = np.where(of[1:] == of[:-1], self.of_bytes[data[:-1].astype(np.int32) << 8 | data[1:]], _NONE)
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            each = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.concatenate([first, [len(of)]])))
            live = each < _NONE
            if not live.all():
                over = ~live
                done.append((of[over], ids[over]))
                count += np.bincount(of[over], minlength=len(raw))
                ids, of, rank, each = ids[live], of[live], rank[live], each[live]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == each)
            at = at[np.concatenate([[True], of[at[1:]] != of[at[:-1]]])]
            ids[at] = self.merged[each[at]]
            left = np.ones(len(ids), bool)
            left[at + 1] = False
            ids, of, rank = ids[left], of[left], rank[left]
            at -= np.arange(len(at))  # as many have gone before each
            near = np.concatenate([at, at[at > 0] - 1])
            rank[near] = self._ranks(ids, of, near)
        if not done:
            return np.empty(0, np.int32), count
        of, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(of, kind="stable")], count

    def _ranks(self, ids: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that start at some places, _NONE where the merges have none or a piece ends."""
        out = np.full(len(at), _NONE)
        inner = np.flatnonzero(at + 1 < len(ids))
        inner = inner[of[at[inner]] == of[at[inner] + 1]]
        a = at[inner]
        out[inner] = self.ranks.get(ids[a].astype(np.int64) << 32 | ids[a + 1], int(_NONE))
        return out


class Builder:
    """The smallest acyclic transducer of words that come in ascending order, each with a sequence of ids."""

    def __init__(self):
        self.number: dict[tuple, int] = {}  # what a finished state is -> its number
        self.last, self.open, self.words = b"", [_State()], 0

    def add(self, word: bytes, ids: tuple[int, ...]) -> None:
        last, states = self.last, self.open
        if self.words and word <= last:
            raise ValueError("words must ascend")
        self.words += 1
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        self._finish(shared)
        for i in range(shared):  # ids stay on an arc as far as the new word agrees, and move beyond it otherwise
            own = states[i].out[word[i]]
            k = 0
            while k < min(len(own), len(ids)) and own[k] == ids[k]:
                k += 1
            if k < len(own):
                states[i].out[word[i]] = own[:k]
                states[i + 1].push(own[k:])
            ids = ids[k:]
        for byte in word[shared:]:
            states[-1].out[byte] = ids
            states[-1].to[byte] = -1
            states.append(_State())
            ids = ()
        states[-1].end = ids
        self.last = word

    def _finish(self, depth: int) -> None:
        """Give the last word's states beyond a depth their numbers."""
        while len(self.open) > depth + 1:
            state = self.open.pop()
            self.open[-1].to[self.last[len(self.open) - 1]] = self._known(state)

    def _known(self, state: _State) -> int:
        return self.number.setdefault((state.end, tuple([(b, state.to[b], o) for b, o in state.out.items()])), len(self.number))

    def image(self) -> bytes:
        """The automaton as a file: sizes, then arrays. State 0 is no state; sequence 0 is empty."""
        self._finish(0)
        root = self._known(self.open[0])
        pool: dict[tuple[int, ...], int] = {(): 0}
        end, keys, values = np.zeros(len(self.number) + 1, np.int64), [], []
        for (final, arcs), n in self.number.items():
            end[n + 1] = -1 if final is None else pool.setdefault(final, len(pool))
            for byte, to, out in arcs:
                keys.append((n + 1) << 8 | byte)
                values.append((to + 1) << 32 | pool.setdefault(out, len(pool)))
        table = Hash.of(np.array(keys, np.int64), np.array(values, np.int64))
        starts = np.concatenate([[0], np.cumsum([len(s) for s in pool])]).astype(np.int64)
        ids = np.array([i for s in pool for i in s], np.int64)
        arrays = [table.keys, table.values, end, starts, ids]
        return np.array([root + 1, table.probes, *map(len, arrays)], "<i8").tobytes() + b"".join(a.astype("<i8").tobytes() for a in arrays)


class _State:
    __slots__ = ("out", "to", "end")

    def __init__(self):
        self.out: dict[int, tuple[int, ...]] = {}
        self.to: dict[int, int] = {}
        self.end: tuple[int, ...] | None = None

    def push(self, ids: tuple[int, ...]) -> None:
        """Put ids before all that leaves or ends here."""
        for byte, own in self.out.items():
            self.out[byte] = ids + own
        if self.end is not None:
            self.end = ids + self.end


class Lexicon:
    """Reads an image in place."""

    def __init__(self, image: bytes | mmap.mmap):
        head = np.frombuffer(image, "<i8", 7)
        arrays, at = [], head.nbytes
        for n in head[2:].tolist():
            arrays.append(np.frombuffer(image, "<i8", n, at))
            at += 8 * n
        keys, values, self.ends, self.starts, self.ids = arrays
        self.root, self.arcs = int(head[0]), Hash(keys, values, int(head[1]))

    @classmethod
    def map(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is there, the ids of those that are in a row, and how many each word has."""
        parts = [self._look_up(words[i : i + 65_536]) for i in range(0, len(words), 65_536)]
        if not parts:
            return np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data, first = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        longest = min(LONGEST, int(sizes.max(initial=0)))
        state, out = np.full(len(words), self.root, np.int64), np.zeros((len(words), longest + 1), np.int64)
        state[sizes > longest] = 0
        live = np.flatnonzero(state)
        for step in range(longest + 1):
            over = live[sizes[live] == step]
            end = self.ends[state[over]]
            state[over[end < 0]] = 0
            out[over, longest] = np.maximum(end, 0)
            live = live[sizes[live] > step]
            if not len(live):
                break
            arc = self.arcs.get(state[live] << 8 | data[first[live] + step], 0)
            state[live], out[live, step] = arc >> 32, arc & 0xFFFFFFFF
            live = live[arc > 0]
        there = state > 0
        out[~there] = 0
        used = out.ravel()
        used = used[used > 0]
        lengths = self.starts[used + 1] - self.starts[used]
        each = (self.starts[out + 1] - self.starts[out]).sum(axis=1)
        return there, self.ids[_ranges(self.starts[used], lengths)], each


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, in a row."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Numbers(dict):
    def __missing__(self, key: str | bytes | int) -> int:
        n = self[key] = len(self)
        return n


class Coder:
    """Encodes and decodes groups of texts; what a Python worker keeps: a tokenizer, a lexicon, and the ids of chunks met lately."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None, most: int = 300_000):
        self.merges, self.lexicon, self.most = merges, lexicon, most
        known = [b or b"" for b in merges.bytes_of]
        self.sizes = np.fromiter(map(len, known), np.int64, len(known))
        self.starts, self.bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(known), np.uint8)
        self.known = np.array([b is not None for b in merges.bytes_of])
        self._keep({}, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))

    def _keep(self, number: dict, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Where the ids of each numbered chunk stand."""
        self.number, self.at, self.counts, self.ids = _Numbers(number), starts, counts, ids

    def chunks(self, text: str) -> list[str | bytes | int]:
        """Parts whose encodings are independent. A string has a space before it, or starts with a line feed; bytes stand as they are; a
        number is an added token's id."""
        find = self.merges.find_added
        if find and any(s in text for s in self.merges.added):
            return [c for i, part in enumerate(find.split(text)) for c in ([self.merges.added[part]] if i % 2 else self._chunks(part))]
        return self._chunks(text)

    def _chunks(self, text: str) -> list[str | bytes]:
        if not text:
            return []
        if plain(text):
            first, *rest = text.replace("\n", " \n").split(" ")
            return [first.encode(), *rest] if first else rest
        return [x[1:] if x[0] == " " and x[1:2] not in ("", "\n") else x.encode() for x in _ANY.findall(text)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        number, old = self.number, len(self.number)
        get, parts, chunks = number.__getitem__, [], []
        for t in texts:
            found = self.chunks(t or "")
            chunks.append(len(found))
            parts += map(get, found)
        codes = np.array(parts, np.int64)
        if len(number) > old:
            ids, counts = self._resolved(list(islice(number, old, None)))
            starts = len(self.ids) + np.cumsum(counts) - counts
            self.at, self.counts, self.ids = np.concatenate([self.at, starts]), np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])
        lengths = self.counts[codes]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ends = upto[np.cumsum(chunks, dtype=np.int64)] if chunks else upto[:0]
        out = self.ids[_ranges(self.at[codes], lengths)]
        if len(number) > self.most:  # the chunks of these texts stay
            used = np.unique(codes)
            names, counts = list(number), self.counts[used]
            ids = self.ids[_ranges(self.at[used], counts)]
            self._keep({names[k]: i for i, k in enumerate(used.tolist())}, np.cumsum(counts) - counts, counts, ids)
        return out, np.diff(np.concatenate([[0], ends]))

    def _resolved(self, keys: list[str | bytes | int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, and how many each has: from the lexicon, or by merging."""
        counts, there = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        which, found = [], []
        if self.lexicon is not None:
            words = [i for i, k in enumerate(keys) if type(k) is str]
            there[words], ids, counts[words] = self.lexicon.look_up([keys[i].encode() for i in words])
            which.append(np.flatnonzero(there))
            found.append(ids)
        added = [i for i, k in enumerate(keys) if type(k) is int]
        if added:
            there[added], counts[added] = True, 1
            which.append(np.array(added))
            found.append(np.array([keys[i] for i in added]))
        others = np.flatnonzero(~there)
        if len(others):
            pieces, each = self.merges.pieces([keys[i].decode() if type(keys[i]) is bytes else keys[i] if keys[i][:1] == "\n" else " " + keys[i] for i in others.tolist()])
            ids, of_piece = self.merges.merge(pieces)
            counts[others] = np.add.reduceat(of_piece, np.cumsum(each) - each)
            which.append(others)
            found.append(ids)
        which, found = np.concatenate(which), np.concatenate(found)
        starts = np.zeros(len(keys), np.int64)
        starts[which] = np.cumsum(counts[which]) - counts[which]
        return found[_ranges(starts, counts)].astype(np.int32), counts

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of ids in a row, ``sizes`` of them for each."""
        if len(ids) and (int(ids.max()) >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id isn't in the vocabulary")
        lengths = self.sizes[ids]
        data = self.bytes[_ranges(self.starts[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in pairwise(ends)]


def frequent_words(docs: DataFrame, size: int, least: int = 2, text: str = "text") -> list[str]:
    """The chunks that stand ``least`` times and more in all texts, the most frequent ones by eighths of powers of two, at most ``size``."""
    chunk = F.explode(F.split(F.replace(F.col(text).cast("string"), F.lit("\n"), F.lit(" \n")), " "))
    counted = docs.select(chunk.alias("word")).where(F.octet_length("word").between(1, LONGEST)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    table = Table(counted.withColumn("level", F.floor(8 * F.log2("n")).cast("int")), "words")
    try:
        levels = table.df.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()  # eight for each power of two
        lowest, room = None, size
        for level, n in sorted(levels, reverse=True):
            if n > room:
                break
            lowest, room = level, room - n
        if lowest is None:
            return []
        return [r[0] for r in table.df.where(F.col("level") >= lowest).select("word").collect()]  # at most size
    finally:
        table.drop()


def compile_words(words: list[str], merges: Merges) -> bytes:
    """The image of a lexicon of chunks."""
    coder, builder = Coder(merges, None), Builder()
    sorted_words = sorted({w.encode() for w in words if w and not (merges.find_added and merges.find_added.search(w))})
    for i in range(0, len(sorted_words), 50_000):
        part = sorted_words[i : i + 50_000]
        # A space stands before each, so that its first chunk is the one that the lexicon means.
        ids, sizes = coder.encode([w.decode() if w[:1] == b"\n" else " " + w.decode() for w in part])
        ids, ends = ids.tolist(), np.concatenate([[0], np.cumsum(sizes)]).tolist()
        for w, a, b in zip(part, ends, ends[1:], strict=False):
            builder.add(w, tuple(ids[a:b]))
    return builder.image()


def ship(spark: SparkSession, image: bytes) -> str:
    """Write an image to the shared folder and have Spark bring it to each executor, now and when one joins; its name there. It stays as long
    as the session, as executors that join later ask for it."""
    path = shared_path(spark, "lexicon")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        for i in range(0, len(image), 1 << 22):
            out.write(bytearray(image[i : i + (1 << 22)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _coder(name: str | None, tokenizer: str | None) -> Coder:
    def make() -> Coder:
        from pyspark import SparkFiles

        return Coder(Merges(tokenizer), Lexicon.map(SparkFiles.get(name)) if name else None)

    return held("lexicon", (name, tokenizer), make)


def round_trip(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = 200_000, tokenizer: str | None = None) -> DataFrame:
    """The columns ``keep``, ids (little-endian unsigned 32-bit integers, binary) and decoded (the text that they decode to)."""
    words = frequent_words(docs, size, text=text) if size else []
    name = ship(docs.sparkSession, compile_words(words, Merges(tokenizer))) if words else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, tokenizer)
        for b in batches:
            held, weight, first = [], 0, 0
            for i, t in enumerate(b.column(1)):
                held.append(t.as_py())
                weight += len(held[-1] or "")
                if weight >= GROUP_BYTES or i + 1 == b.num_rows:
                    ids, sizes = coder.encode(held)
                    ends = np.concatenate([[0], np.cumsum(4 * sizes)]).astype(np.int64)
                    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(held), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(held)), packed.cast(pa.binary()), pa.array(coder.decode(ids, sizes), pa.string())], ["row", "ids", "decoded"])
                    held, weight, first = [], 0, i + 1
            tidy()

    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]))
    return found.select(*(F.col("row")[c].alias(c) for c in keep), "ids", "decoded")


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
