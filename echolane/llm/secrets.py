"""Secret scan with multipart credential linking.

Strong kinds are reported wherever they stand: assigned secrets, access key ids, long hex runs.
Weak parts say little alone: names that could be access ids, mixed tokens that could be secrets,
and endpoints. Inside a scope, which is ``SCOPE`` characters around a part, they complete each
other: a weak secret is reported beside an access id or an endpoint, a weak id beside a secret, an
endpoint only beside both. Intervals are joined by sorting: for every weak part and kind one search
tells whether any part of that kind reaches into its scope, so a text full of parts costs no pairs.

Defined cases: a missing text is an empty one; equal rows get equal rows; an empty table gives
none; only ``doc_id`` and ``text`` are read. Places are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import digest, lower_ascii, map_batches, text_rows

# The strong kinds and their least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

KINDS = ["assign", "access", "hex", "id", "key", "host"]

# Weak parts, and how far the scope of one reaches to both sides.
WEAK_ID = r"""\b(?:user(?:name)?|login|client[_-]?id|account(?:[_-]?id)?|access[_-]?key(?:[_-]?id)?)["']?[ \t]*[:=][ \t]*["']?[A-Za-z0-9._@-]{3,}"""
WEAK_ASSIGN = r"""\b(?:pwd|pass|auth|credentials?|private[_-]?key)["']?[ \t]*[:=][ \t]*["']?[A-Za-z0-9+/_.=-]{6,}"""
WEAK_TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
HOST = r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|\b(?:host|endpoint|server|url)["']?[ \t]*[:=][ \t]*["']?[A-Za-z0-9._:/-]{4,}"""
SCOPE = 200

_ASSIGN, _ACCESS = re.compile(ASSIGN, re.A | re.I), re.compile(ACCESS)
# The same matches as those of HEX that are long enough, without stopping at every short run.
_HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{MIN_HEX},}}")
_WEAK_ID, _WEAK_ASSIGN, _HOST = (re.compile(x, re.A | re.I) for x in (WEAK_ID, WEAK_ASSIGN, HOST))
_WEAK_TOKEN = re.compile(WEAK_TOKEN)
_NAMES = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
_HEX_RUN = bytes(120 if chr(i) in "0123456789abcdef" else 46 for i in range(256))
_TOKEN_RUN = bytes(120 if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_=-") else 46 for i in range(256))

Span = tuple[int, int, str]


def strong_spans(text: str, small: bytes) -> list[Span]:
    """The strong kinds; ``small`` is the text's lower-cased UTF-8."""
    spans: list[Span] = []
    if any(name in small for name in _NAMES):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if b"x" * MIN_HEX in text.encode("utf-8", "surrogatepass").translate(_HEX_RUN):
        spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _mixed(token: str) -> bool:
    """Small and capital letters and digits, and at least ten different characters."""
    return len(set(token)) >= 10 and any(map(str.islower, token)) and any(map(str.isupper, token)) and any(map(str.isdigit, token))


class _Reach:
    """Whether any of some intervals comes within reach of another one."""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans)
        self.starts = [s[0] for s in spans]
        self.ends = list(accumulate((s[1] for s in spans), max))

    def __call__(self, span: Span) -> bool:
        before = bisect_right(self.starts, span[1] + SCOPE)
        return before > 0 and self.ends[before - 1] >= span[0] - SCOPE


def linked_spans(text: str, small: bytes, strong: list[Span]) -> list[Span]:
    """Weak parts whose complement stands in their scope."""
    weak: list[Span] = []
    if b"=" in small or b":" in small:
        weak += [(m.start(), m.end(), "id") for m in _WEAK_ID.finditer(text)]
        weak += [(m.start(), m.end(), "key") for m in _WEAK_ASSIGN.finditer(text)]
        weak += [(m.start(), m.end(), "host") for m in _HOST.finditer(text)]
    if b"x" * 20 in small.translate(_TOKEN_RUN):
        weak += [(m.start(), m.end(), "key") for m in _WEAK_TOKEN.finditer(text) if _mixed(m[0])]
    if not weak:
        return []
    taken = _Overlap(strong)
    weak = [span for span in sorted(set(weak)) if not taken(span)]
    # A token inside an endpoint or a named part belongs to that part.
    named = _Overlap([span for span in weak if span[2] != "key"])
    weak = [span for span in weak if span[2] != "key" or not named(span)]
    ids = _Reach([s for s in strong if s[2] == "access"] + [s for s in weak if s[2] == "id"])
    keys = _Reach([s for s in strong if s[2] != "access"] + [s for s in weak if s[2] == "key"])
    hosts = _Reach([s for s in weak if s[2] == "host"])
    complete = {"key": lambda s: ids(s) or hosts(s), "id": keys, "host": lambda s: ids(s) and keys(s)}
    return [span for span in weak if complete[span[2]](span)]


class _Overlap(_Reach):
    def __call__(self, span: Span) -> bool:
        before = bisect_right(self.starts, span[1] - 1)
        return before > 0 and self.ends[before - 1] > span[0]


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Strong spans and linked weak ones."""
    small = lower_ascii(text)
    strong = strong_spans(text, small)
    return strong, linked_spans(text, small, strong)


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked`` for every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")}
            for text in batch.column("text").to_pylist():
                strong, linked = scan(text)
                count = Counter(kind for *_, kind in strong)
                every = sorted(strong + linked, key=lambda s: (s[0], KINDS.index(s[2])))
                told = [[f"{kind}:{start}:{end}" for start, end, kind in spans] for spans in (strong, every)]
                row = (count["assign"], count["access"], count["hex"], digest(told[0]), ",".join(told[1]), len(linked))
                for name, value in zip(out, row):
                    out[name].append(value)
            yield {"doc_id": batch.column("doc_id")} | out

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    return map_batches(text_rows(docs), work, schema)
