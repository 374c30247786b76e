"""Cutting a text into chunks whose byte-level BPE encodings are independent, with caches of what each encodes to.

The splitting pattern of the tokenizers never lets a match go from a character that isn't white space to one that is, and its
only look-ahead is at white space. So a text may be cut wherever such a pair stands, and each chunk encoded alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: White space as Unicode has it (not as Python's re has it, which adds four separators).
WS = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2000))) + "-" + "".join(map(chr, (0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_RUN = re.compile(f"[{WS}][{WS}]")
_ANY = re.compile(f"[{WS}]*[^{WS}]+|[{WS}]+")
_RARE = ("\t", "\v", "\f", "\r")


def plain(text: str) -> bool:
    """Whether white space in the text never comes twice in a row."""
    if "  " in text or "\n\n" in text or "\n " in text or " \n" in text:
        return False
    if text.isascii() and not any(c in text for c in _RARE):
        return True
    return _RUN.search(text) is None


#: Marks that often end a word. After a letter each is a match of the pattern of its own.
_MARKS = frozenset(".,;:!?")
_SLOTS = 1 << 22


class ChunkCache(dict):
    """Chunk to value. Keys are chunks without the one space before them, or with the line feed before them.

    encode takes any chunk; encode_word takes a space and Latin letters, which are one match of the pattern. A word with a mark at
    its end is put together from the two, so that it costs no encoding of its own. A chunk is kept from the second time on that it is
    met, as most chunks are met once: a byte for each of _SLOTS hashes tells which were. Two generations bound the memory."""

    def __init__(self, encode: Callable[[str], bytes], encode_word: Callable[[str], bytes], most: int = 250_000):
        super().__init__()
        self.encode, self.encode_word, self.most, self.old, self.met = encode, encode_word, most, {}, bytearray(_SLOTS)
        self.marks = {m: encode(m) for m in _MARKS}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            if key.isalpha() and max(key) < "\u0250":
                value = self.encode_word(" " + key)
            elif key[-1:] in _MARKS and key[:-1].isalpha() and max(key) < "\u0250":
                value = self[key[:-1]] + self.marks[key[-1]]
            else:
                value = self.encode(key if key[:1] == "\n" else " " + key)
            slot = hash(key) & (_SLOTS - 1)
            if not self.met[slot]:
                self.met[slot] = 1
                return value
        self[key] = value
        return value

    def of(self, text: str) -> bytes:
        """The joined values of a text's chunks."""
        if not text:
            return b""
        if plain(text):
            first, *rest = text.replace("\n", " \n").split(" ")
            out = b"".join([self.encode(first) if first else b"", *map(self.__getitem__, rest)])
        else:
            out = b"".join([self[x[1:]] if x[0] == " " and x[1:2] not in ("", "\n") else self.encode(x) for x in _ANY.findall(text)])
        if len(self) > self.most:
            self.old, self.met = dict(self), bytearray(_SLOTS)
            self.clear()
        return out
