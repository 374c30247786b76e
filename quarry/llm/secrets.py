"""Secret scans with multipart credential linking.

Strong spans stand alone: assignments of a value to a secret-like name, access identifiers, hexadecimal runs. Weak candidates (a
mixed high-entropy token, an account name or key id, an endpoint) are common in clean text. They are parts of a credential only
where complementary parts meet: parts of a text are interval-joined within a scope (positions at most ``scope`` apart, swept in
order of position), and a weak secret is reported only near an identifier or an endpoint, a weak identifier or endpoint only near a
secret. ``credentials`` says which parts belong together: each secret with the nearest identifier and endpoint of its scope.

A text's parts never leave its row, so a scan needs no shuffle and has one row's parts in memory. Time is linear in a text's length, but for sorting its spans.

Cases: a null text is empty and has no span; positions are code points, ends exclusive; ties are ordered by kind; rows stay one to
one with the input, so null or repeated ids need no rule; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held, small_batches, tidy

#: Strong kinds first; spans are ordered by start, then by place in this list.
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "endpoint")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ID = re.compile(r"""(?:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII)
_SCHEME = "0123456789+.-abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_AFTER_SCHEME = re.compile(r"[^\s\"'<>]+", re.ASCII)
_ADDRESS = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?(?![\w.])", re.ASCII)
#: Tables that mark the characters of a class, to find out whether a run of some length exists at all.
_IS_HEX = bytes(104 if chr(i) in "0123456789abcdef" else 46 for i in range(256))
_IS_TOKEN = bytes(116 if re.match(r"[A-Za-z0-9+/_-]", chr(i)) and i < 128 else 46 for i in range(256))

Span = tuple[int, int, int]  # start, place of the kind, end


def entropy(x: str) -> float:
    """Bits a character."""
    return -sum(c / len(x) * math.log2(c / len(x)) for c in Counter(x).values())


def _strong(text: str, raw: bytes) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"h" * 16 in raw.translate(_IS_HEX):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def _endpoints(text: str) -> list[Span]:
    """Addresses with a scheme, [a-z][a-z0-9+.-]*://[^\\s"'<>]+ in either case, and numeric ones outside of them.

    Each :// is extended to the left, at most to the end of the last address, so that a run of letters is looked at once."""
    out: list[Span] = []
    end, at = 0, text.find("://")
    while at >= 0:
        before = text[end:at]
        run = before[len(before.rstrip(_SCHEME)) :].lstrip("0123456789+.-")
        rest = _AFTER_SCHEME.match(text, at + 3) if run else None
        if rest:
            end = rest.end()
            out.append((at - len(run), 5, end))
        at = text.find("://", max(end, at + 3))
    taken = Taken(out)
    return out + [(m.start(), 5, m.end()) for m in _ADDRESS.finditer(text) if taken.clear(*m.span())]


class Taken:
    """Spans merged to disjoint ones, to ask whether a range is clear of them."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, _, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def clear(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return not i or self.ends[i - 1] <= start


class Intervals:
    """Spans in order, to find those near another: an interval join by position."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans)
        self.starts = [x[0] for x in self.spans]
        self.furthest: list[int] = []  # place of the interval that ends last among those up to here
        for i, x in enumerate(self.spans):
            last = self.furthest[-1] if self.furthest else i
            self.furthest.append(i if x[2] > self.spans[last][2] else last)

    def nearest(self, span: Span, scope: int) -> Span | None:
        """The interval with the smallest gap to span, at most ``scope``; of equal gaps the one before."""
        i = bisect_left(self.starts, span[2])
        best, gap = None, scope + 1
        if i:  # of all intervals that start before span's end the one that ends last is nearest
            before = self.spans[self.furthest[i - 1]]
            best, gap = before, max(0, span[0] - before[2])
        if i < len(self.spans) and self.starts[i] - span[2] < gap:
            best, gap = self.spans[i], self.starts[i] - span[2]
        return best if gap <= scope else None


def _weak(text: str, raw: bytes, strong: list[Span], scope: int) -> list[Span]:
    taken = Taken(strong)
    tokens: list[Span] = []
    if b"t" * 20 in raw.translate(_IS_TOKEN):
        for m in _TOKEN.finditer(text):
            x = m[0]
            if any(c.isdigit() for c in x) and any(c.isupper() for c in x) and any(c.islower() for c in x) and entropy(x) >= 3.5 and taken.clear(*m.span()):
                tokens.append((m.start(), 3, m.end()))
    secrets = tokens + [s for s in strong if s[1] in SECRETS]
    if not secrets:
        return []
    ids = [(m.start(), 4, m.end()) for m in _ID.finditer(text) if taken.clear(*m.span())]
    parts = ids + [x for x in _endpoints(text) if taken.clear(x[0], x[2])]
    near_parts, near_secrets = Intervals(parts + [s for s in strong if s[1] == 1]), Intervals(secrets)
    return [x for x in tokens if near_parts.nearest(x, scope)] + [x for x in parts if near_secrets.nearest(x, scope)]


def find(text: str | None, scope: int = 200) -> list[Span]:
    """All spans of a text, in order."""
    if not text:
        return []
    raw = text.encode("utf-8", "replace")
    strong = _strong(text, raw)
    return sorted(strong + _weak(text, raw, strong, scope))


#: Places in KINDS of the parts of a credential.
SECRETS, IDENTIFIERS, ENDPOINTS = (0, 2, 3), (1, 4), (5,)


def link(spans: list[Span], scope: int = 200) -> list[tuple[Span, Span | None, Span | None]]:
    """Credentials: each secret with the nearest identifier and the nearest endpoint in its scope, if it has either."""
    ids, ends = (Intervals([s for s in spans if s[1] in kinds]) for kinds in (IDENTIFIERS, ENDPOINTS))
    found = [(s, ids.nearest(s, scope), ends.nearest(s, scope)) for s in spans if s[1] in SECRETS]
    return [x for x in found if x[1] or x[2]]


SPANS = "array<struct<kind:string,start:int,end:int>>"
#: Start and end of a secret and of the parts linked with it; null where a part is missing.
CREDENTIALS = "array<struct<secret_start:int,secret_end:int,id_start:int,id_end:int,endpoint_start:int,endpoint_end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_NAMES_OF_PARTS = ("secret_start", "secret_end", "id_start", "id_end", "endpoint_start", "endpoint_end")
_CREDENTIALS = pa.list_(pa.struct([(n, pa.int32()) for n in _NAMES_OF_PARTS]))


def finder(scope: int = 200) -> Callable[[Column], Column]:
    """A function from a text column to struct(spans, credentials, redacted); redacted is null where nothing was found.

    Texts alone go to Python, and unchanged ones don't come back."""
    kind = pa.struct([("spans", _SPANS), ("credentials", _CREDENTIALS), ("redacted", pa.string())])

    def one(text: str | None) -> dict:
        spans = find(text, scope)
        ends = lambda x: (x[0], x[2]) if x else (None, None)
        linked = [dict(zip(_NAMES_OF_PARTS, ends(a) + ends(b) + ends(c), strict=True)) for a, b, c in link(spans, scope)] if spans else []
        return {"spans": [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans], "credentials": linked, "redacted": redact(text, spans) if spans else None}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("secrets")
        tidy()
        for whole in batches:
            yield pa.array([one(x.as_py()) for x in whole], kind)

    small_batches()
    return F.arrow_udf(run, f"struct<spans:{SPANS},credentials:{CREDENTIALS},redacted:string>").asNondeterministic()


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", scope: int = 200) -> DataFrame:
    """The columns ``keep``, ``spans``, ``credentials`` and ``redacted`` (the text with each run of spans replaced by its first kind)."""
    body = F.col(text).cast("string")
    found = docs.select(F.struct(*keep).alias("row"), body.alias("body"), finder(scope)(body).alias("found"))
    return found.select(*(F.col("row")[c].alias(c) for c in keep), "found.spans", "found.credentials", F.coalesce("found.redacted", "body").alias("redacted"))


def redact(text: str, spans: list[Span]) -> str:
    """The text with overlapping spans merged and replaced by a mark that names the first one's kind."""
    out, at, end, kind = [], 0, -1, 0
    for s, k, e in spans:
        if s < end:
            end = max(end, e)
            continue
        if end >= 0:
            out.append(f"<{KINDS[kind]}>")
            at = end
        out.append(text[at:s])
        end, kind = e, k
    if end >= 0:
        out.append(f"<{KINDS[kind]}>")
        at = end
    return "".join([*out, text[at:]])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    n = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    base = F.filter("spans", lambda x: x.kind.isin("assign", "access", "hex"))
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
