"""Secret scan: base patterns, and weak parts that count only beside their complements."""

from __future__ import annotations

import bisect
import re
from itertools import accumulate

from pyspark.sql import DataFrame

from kinescape.llm.common import arrow_rows, slices

#: Base kinds in the order in which spans of one start are listed, then the linked kinds.
KINDS = ("assign", "access", "hex", "linked_secret", "linked_endpoint")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak parts: 40 characters of a key's alphabet standing alone, or after the = of a name; a host or address of a service.
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
_URL = re.compile(r"(?:https?|s3|amqp|postgres|mysql|redis|mongodb)://[^\s\"'<>]+")
_HOST, _SERVICE = re.compile(r"[a-z0-9.-]+"), ".amazonaws.com"
_TO_HEX = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_TO_KEY = bytes(
    0x68 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/" else 0x20
    for b in range(256)
)
_HEX_RUN, _KEY_RUN = b"h" * 24, b"h" * 40


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base matches, in code points."""
    found: list[tuple[int, int, int]] = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_TO_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def scopes(text: str) -> list[int]:
    """Starts of the text's scopes: parts between empty lines."""
    return [0, *(m.end() for m in re.finditer(r"\n[ \t\r]*\n", text))]


def endpoints(text: str) -> list[tuple[int, int]]:
    """Addresses of services, and hosts of one provider outside them; each place is looked at once."""
    found = [m.span() for m in _URL.finditer(text)] if "://" in text else []
    if _SERVICE in text:
        urls = Intervals(found)
        for m in _HOST.finditer(text):
            stop = m.group().rfind(_SERVICE)
            if stop < 0 or text[m.start() + stop + len(_SERVICE) :][:1] == "_" or text[m.start() + stop + len(_SERVICE) :][:1].isalnum():
                continue
            start = m.start() + len(m.group()) - len(m.group().lstrip(".-"))
            span = start, m.start() + stop + len(_SERVICE)
            if start < m.start() + stop and not urls.meets(span):
                found.append(span)
    return sorted(found)


class Intervals:
    """Spans by start, with the furthest end up to each: what lies near a span is told by two of them."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.furthest = [*accumulate((e for _, e in spans), max)]

    def gap(self, span: tuple[int, int]) -> float:
        """Places between ``span`` and the nearest of these, 0 or less if one meets it."""
        at = bisect.bisect_right(self.starts, span[0])
        left = span[0] - self.furthest[at - 1] if at else float("inf")
        return min(left, self.starts[at] - span[1]) if at < len(self.starts) else left

    def meets(self, span: tuple[int, int]) -> bool:
        return self.gap(span) < 0


def linked_spans(text: str, base: list[tuple[int, int, int]], reach: int) -> list[tuple[int, int, int]]:
    """Weak parts that co-occur with complementary ones.

    Access identifiers, weak secrets and endpoints are intervals, which may nest; two of them
    join if they lie in one scope with at most ``reach`` code points between them. A weak secret
    counts beside an identifier; an endpoint counts beside an identifier or assigned secret. A
    weak part that meets a base span is part of it. An interval join by a sweep: of the parts
    that begin before, the furthest end decides, of those after, the first start.
    """
    if not any(k < 2 for _, k, _ in base):
        return []
    edges = scopes(text)
    scope = lambda at: bisect.bisect_right(edges, at)
    beside: dict[tuple[int, int], list] = {}
    for s, k, e in base:
        if k < 2:
            beside.setdefault((4, scope(s)), []).append((s, e))
        if k == 1:
            beside.setdefault((3, scope(s)), []).append((s, e))
    known, taken = {at: Intervals(spans) for at, spans in beside.items()}, Intervals([(s, e) for s, _, e in base])
    weak = [(4, span) for span in endpoints(text)]
    if any(k == 1 for _, k, _ in base) and _KEY_RUN in text.encode("utf-8", "surrogatepass").translate(_TO_KEY):
        weak += [(3, m.span()) for m in WEAK_SECRET.finditer(text)]
    found = []
    for kind, span in weak:
        near = known.get((kind, scope(span[0])))
        if near and near.gap(span) <= reach and not taken.meets(span):
            found.append((span[0], kind, span[1]))
    return sorted(found)


def find_spans(text: str | None, reach: int = 400) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and linked spans of a text; null is empty."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, linked_spans(text, base, reach) if base else []


def scan(df: DataFrame, reach: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of each whole text: ``key``, spans array<struct<kind, start, end, linked>>, one row each.

    Base kinds: assign, access, hex. Linked kinds: linked_secret and linked_endpoint, weak parts
    reported only when their complement lies in the same scope within ``reach`` code points.
    Starts and ends are code points, the end exclusive; spans are by start, then by kind. A null
    or empty text has no spans; null keys and repeated rows are kept. Very long texts take time
    in proportion to their length. One scan, no shuffle.
    """
    kind = dict(df.dtypes)[key]

    def work(batch):
        for part in slices(batch, 4096):
            rows = []
            for s in part.column(1).to_pylist():
                base, linked = find_spans(s, reach)
                rows.append(
                    [{"kind": KINDS[k], "start": a, "end": b, "linked": k > 2} for a, k, b in sorted(base + linked)]
                )
            yield {key: part.column(0), "spans": rows}

    return arrow_rows(
        df.select(key, text),
        f"`{key}` {kind}, spans array<struct<kind: string, start: long, end: long, linked: boolean>>",
        work,
    )


def redact(df: DataFrame, reach: int = 400, text: str = "text", mark: str = "[{kind}]") -> DataFrame:
    """``df`` with every found span of ``text`` replaced by ``mark``; overlapping spans become one.

    All rows and columns stay; a null text stays null. Work grows with a text's length.
    """
    place = df.columns.index(text)
    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)

    def clean(s: str | None) -> str | None:
        base, linked = find_spans(s, reach)
        if not base and not linked:
            return s
        out, at = [], 0
        for a, k, b in sorted(base + linked):
            if a >= at:
                out += [s[at:a], mark.format(kind=KINDS[k])]
            at = max(at, b)
        return "".join([*out, s[at:]])

    def work(batch):
        for part in slices(batch, 4096):
            out = {c: part.column(i) for i, c in enumerate(df_columns)}
            out[text] = [clean(s) for s in part.column(place).to_pylist()]
            yield out

    df_columns = df.columns
    return arrow_rows(df, schema, work)
