"""Secrets in texts: fixed patterns, and literals assigned to sensitive names in source and configuration syntax.

A lexer reads assignments (`name = "literal"`, `name: literal`, `"name": "literal"`, `export NAME=literal`,
`name => 'literal'`) as pairs of a name and a literal or another name, with their places. Constants are carried
along: a literal given to an ordinary name counts for every later sensitive name that is set to that name, and
adjacent literals joined by `+` are one value. Each literal is scored by the sensitive words of the names it
reaches and by its own shape; those above a threshold are secrets.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill.llm.common import texts

# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of [0-9a-f]+ that is long enough
KINDS = ("assign", "access", "hex")

#: How much a part of a name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "apikey": 1.0, "privatekey": 1.0,
    "accesskey": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "pass": 0.7,
    "signature": 0.5, "salt": 0.5, "key": 0.5, "private": 0.4, "access": 0.3, "api": 0.2, "client": 0.1,
}
#: Parts that say the value is about a secret, not one.
HARMLESS = {"name", "length", "len", "type", "url", "uri", "path", "file", "id", "count", "max", "min", "public", "hint", "field", "label", "expires", "ttl"}
#: Values that only stand for a secret.
PLACEHOLDER = re.compile(
    r"(?i)^(?:x+|\*+|\.+|null|none|nil|true|false|undefined|changeme|change_me|example|placeholder|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|todo|test|string|required|optional)$"
)
#: A secret scores so much at least.
THRESHOLD = 1.0

_TOKEN = re.compile(
    r"""
    (?P<name>[A-Za-z_][A-Za-z0-9_]*(?:[.-][A-Za-z_][A-Za-z0-9_]*)*)?   # a bare name, or ...
    (?P<quoted>(?<![A-Za-z0-9_])(?P<q>["'])[A-Za-z_][A-Za-z0-9_. -]{0,63}(?P=q))?  # ... a quoted one
    [ \t]*(?P<sign>:=|=>|=(?!=)|:(?![:/]))[ \t]*
    (?: (?P<literal>(?P<q2>["'`])(?:\\.|(?!(?P=q2))[^\\\r\n])*(?P=q2)(?:[ \t]*\+[ \t]*(?P<q3>["'`])(?:\\.|(?!(?P=q3))[^\\\r\n])*(?P=q3))*)
      | (?P<bare>[A-Za-z0-9_+/.$\{\}=~!@\#%^&*-]+) )
    """,
    re.X,
)
_SIGN = re.compile(r"[=:]")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PIECE = re.compile(r"""(["'`])((?:\\.|(?!\1)[^\\])*)\1""")


class Span(NamedTuple):
    """A secret: its kind, where it is in code points, and its score."""

    start: int
    end: int
    kind: str
    score: float


def base_spans(text: str) -> list[Span]:
    """The matches of the three patterns that are long enough."""
    found = []
    if ":" in text or "=" in text:
        found = [Span(*m.span(), "assign", 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [Span(*m.span(), "access", 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [Span(*m.span(), "hex", 1.0) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def name_score(name: str) -> float:
    """How sensitive a name is: its strongest parts, or two joined ones, less for harmless parts."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    score = sum(sorted((SENSITIVE.get(p, 0.0) for p in {*parts, *joined}), reverse=True)[:2])
    return score - 0.8 * sum(p in HARMLESS for p in parts[-1:]) - 0.4 * sum(p in HARMLESS for p in parts[:-1])


def value_score(value: str) -> float:
    """How much a value looks like a secret: long, without blanks, of many and mixed characters."""
    n = len(value)
    if n < 6 or PLACEHOLDER.match(value):
        return -2.0
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value), re.search("[^A-Za-z0-9]", value))))
    score = 0.2 * min(entropy - 2.0, 2.0) + 0.15 * (kinds - 1) + 0.1 * (n >= 16)
    if re.search(r"\s", value):
        score -= 0.6
    if re.fullmatch(r"[0-9.,:/-]+", value):
        score -= 0.5
    if re.match(r"(?i)https?://|/[a-z]+/", value):
        score -= 0.8
    return score


def assignments(text: str) -> Iterator[tuple[str, str | None, str | None, int, int]]:
    """(target name, literal, source name, start and end of the value) of each assignment, in order."""
    at = 0
    for sign in _SIGN.finditer(text):
        if sign.start() < at:
            continue
        # Step back over blanks and the name that may stand before the sign.
        i = sign.start()
        while i > at and text[i - 1] in " \t":
            i -= 1
        quote = i > at and text[i - 1] in "\"'"
        j = i - 1 if quote else i
        while j > at and i - j < 130 and (text[j - 1].isascii() and (text[j - 1].isalnum() or text[j - 1] in "_.-")):
            j -= 1
        if quote and j > at and text[j - 1] == text[i - 1]:
            j -= 1
        m = _TOKEN.match(text, j)
        if not m or not (m["name"] or m["quoted"]) or m.start("sign") != sign.start():
            continue
        name = m["name"] or m["quoted"][1:-1]
        if m["literal"] is not None:
            pieces = list(_PIECE.finditer(text, *m.span("literal")))
            yield name, "".join(p[2] for p in pieces), None, m.start("literal") + 1, m.end("literal") - 1
        else:
            bare = m["bare"].rstrip(".,;")
            start = m.start("bare")
            if not bare:
                continue
            as_name = bare if re.fullmatch(r"\$?\{?[A-Za-z_][A-Za-z0-9_.]*\}?", bare) else None
            yield name, bare, as_name and as_name.strip("${}"), start, start + len(bare)
        at = m.end()


def assigned_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Literals that reach a sensitive name, with the best score among the names they reach."""
    if "=" not in text and ":" not in text:
        return []
    constants: dict[str, tuple[str, int, int]] = {}
    best: dict[tuple[int, int], float] = {}
    for name, literal, source, start, end in assignments(text):
        value, place = literal, (start, end)
        if source is not None and source in constants:  # a constant carried along
            value, *place = constants[source]
            place = tuple(place)
        elif source is not None and name_score(source.rsplit(".", 1)[-1]) > 0:
            value = None  # set from another sensitive name whose value is elsewhere
        if value is None:
            continue
        constants[name.rsplit(".", 1)[-1]] = (value, *place)
        constants[name] = (value, *place)
        sensitive = name_score(name)
        if sensitive >= 0.5:
            score = sensitive + value_score(value)
            if score >= threshold:
                best[place] = max(score, best.get(place, 0.0))
    return [Span(s, e, "literal", round(v, 3)) for (s, e), v in sorted(best.items())]


def secrets(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Base spans, and assigned literals that no base span covers, by start."""
    base = base_spans(text)
    more = [s for s in assigned_spans(text, threshold) if not any(b.start <= s.start and s.end <= b.end for b in base)]
    order = {k: i for i, k in enumerate((*KINDS, "literal"))}
    return sorted([*base, *more], key=lambda s: (s.start, order[s.kind], s.end))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def scan(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its secrets: doc_id, found (array of kind, start, end, score), in code points, end exclusive.

    Whole texts are read. Null and empty texts have none. Rows that repeat a document are each scanned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            found = [
                [{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in secrets(t or "", threshold)]
                for t in map(pa.StringScalar.as_py, batch.column("text"))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    schema = "doc_id long, found array<struct<kind: string, start: long, end: long, score: double>>"
    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans as text, from the spans of scan()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[Span(s["start"], s["end"], s["kind"], 0.0) for s in r] for r in batch.column("found").to_pylist()]
            base = [[s for s in r if s.kind in KINDS] for r in rows]
            counts = [pa.array([sum(s.kind == k for s in r) for r in base], pa.int64()) for k in KINDS]
            sums = pa.array([hashlib.sha256(joined(r).encode()).hexdigest() for r in base])
            spans = pa.array([joined(r) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, sums, spans], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
