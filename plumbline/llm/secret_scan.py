"""Secret scans by linking the parts of multipart credentials (operator 9).

Strong spans stand alone. Each kind's matches are leftmost and non-overlapping; those that fail its length are dropped:
assign (a keyword, : or = and a value of 6 or more characters), access (AKIA and capitals or digits, 20 or more in all) and
hex (24 or more of 0-9a-f).

Weak candidates mean nothing alone: identifiers (client_id = ..., user: ...), high-entropy words and endpoints (URLs with a
service scheme, cloud hosts). A high-entropy word has 20 or more characters, without an upper limit, and MIN_ENTROPY bits a
character if it mixes lower case, upper case and digits, MIN_ENTROPY_TWO if it has only two of them. They are joined as intervals with the other parts, strong or weak, of their scope: the same
paragraph, at most SCOPE_CHARS code points apart. An identifier is reported if a secret is in its scope, a high-entropy
word if an identifier or an endpoint is, an endpoint if both are. Parts are sorted once and each scope is found by
bisection, so the join costs n log n for a document.

Offsets are code points, ends exclusive. Defined results: null and empty texts have no spans; texts are read whole; every
row stays, repeated rows and null ids included; columns of the outputs' names are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.common import append_columns

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SCOPE_CHARS = 400
MIN_ENTROPY, MIN_ENTROPY_TWO = 3.5, 3.75


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


ASSIGN = re.compile("(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
IDENTIFIER = re.compile(r"\b" + "(?:" + _either_case("access_?key(?:_?id)?|client_?id|user(?:name)?|login|account") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""")
ENDPOINT = re.compile(r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3|ftp|ssh)://[^\s\"'<>]+|[A-Za-z0-9.-]+\.(?:amazonaws\.com|azure\.com|googleapis\.com)")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
PARAGRAPH = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    spans: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _entropy(word: str) -> float:
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values())


def _random_like(word: str) -> bool:
    classes = bool(re.search("[a-z]", word)) + bool(re.search("[A-Z]", word)) + bool(re.search("[0-9]", word))
    return classes >= 2 and _entropy(word) >= (MIN_ENTROPY if classes == 3 else MIN_ENTROPY_TWO)


class _Scopes:
    """Parts of one role, to be asked whether one lies within a scope."""

    def __init__(self, parts: list[tuple[int, int]]):
        self.parts = sorted(parts)
        self.starts = [a for a, _ in self.parts]
        self.longest = max((b - a for a, b in self.parts), default=0)

    def near(self, a: int, b: int, low: int, high: int) -> bool:
        low, high = max(low, a - SCOPE_CHARS), min(high, b + SCOPE_CHARS)
        i, j = bisect_left(self.starts, low - self.longest), bisect_right(self.starts, high)
        return any(e > low and (s, e) != (a, b) and s < high for s, e in self.parts[i:j])


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """The weak spans whose complementary parts share their scope."""
    identifiers = [(m.start(), m.end()) for m in IDENTIFIER.finditer(text)] if any(k in text.lower() for k in ("key", "client", "user", "login", "account")) else []
    endpoints = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)] if "://" in text or ".com" in text else []
    taken = [(a, b) for a, _, b in base]
    if not identifiers and not endpoints and not any(k == 1 for _, k, _ in base):
        return []  # a high-entropy word needs one of these
    covered = _Scopes(taken + endpoints)
    inside = lambda a, b: any(s < b and e > a for s, e in covered.parts[bisect_left(covered.starts, a - covered.longest) : bisect_right(covered.starts, b)])
    secrets = [(m.start(), m.end()) for m in SECRET.finditer(text) if _random_like(m[0]) and not inside(m.start(), m.end())]
    ids = _Scopes(identifiers + [(a, b) for a, k, b in base if k == 1])
    keys = _Scopes(secrets + [(a, b) for a, k, b in base if k != 1])
    ends = _Scopes(endpoints)
    breaks = [m.start() for m in PARAGRAPH.finditer(text)]

    def scope(a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(breaks, a), bisect_left(breaks, b)
        return breaks[i - 1] if i else 0, breaks[j] if j < len(breaks) else len(text)

    out = [(a, 3, b) for a, b in identifiers if keys.near(a, b, *scope(a, b))]
    out += [(a, 4, b) for a, b in secrets if ids.near(a, b, *scope(a, b)) or ends.near(a, b, *scope(a, b))]
    out += [(a, 5, b) for a, b in endpoints if keys.near(a, b, *scope(a, b)) and ids.near(a, b, *scope(a, b))]
    return out


def secret_spans(df: DataFrame, text_col: str = "text", out_col: str = "secret_spans") -> DataFrame:
    """Add array<struct<kind, start, end>> of all spans of each text, by start and then kind. One pass, no shuffle."""
    at = df.columns.index(text_col)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = []
            for text in batch.column(at).to_pylist():
                base = base_spans(text) if text else []
                found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + linked_spans(text, base))] if text else [])
            yield batch, [found]

    return append_columns(df, [T.StructField(out_col, T.ArrayType(span))], run)
