"""Secret scanning: fixed patterns, and assignment-aware lexing with constant propagation."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_beside_row

#: The base patterns and the least lengths of what they must hold.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

Span = tuple[int, int]
KINDS = ("assign", "access", "hex", "lexed")
LEAST_SCORE = 0.6
_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: How sensitive the parts of a target name are; the highest part counts.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "api_key": 1.0, "access_key": 1.0, "private_key": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7,
    "authorization": 0.8, "bearer": 0.8, "signature": 0.5, "session": 0.4, "salt": 0.5, "key": 0.5,
}

#: Names that say nothing about their value: what they belong to does.
NEUTRAL = frozenset("value val data content text plain raw default literal string".split())

#: A target: name and separator.  Its value is a literal in quotes, a bare literal, or the name of another constant.
_TARGET = re.compile(
    r"""(?<![\w.$-])["']?(?P<name>[A-Za-z_][\w.-]*(?:\[["'][\w.-]+["']\])?)["']?\x20*(?::=|=>|[:=](?![:=]))\x20*"""
)
_OPENING = re.compile(r"""[rbuf]{0,2}(\"{3}|'{3}|["'`])""")
_VALUE = re.compile(r"[^\s,;(){}\[\]<>]")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
#: By quote, in order: within a line, the same without escapes, and across lines, where no word may go on after it.
_CLOSING = {
    q: [re.compile(rf"(?:[^\\\n{q}]|\\.)*+{q}"), re.compile(rf"[^\n{q}]*+{q}(?![^\s,;)}}\]])"), re.compile(rf"(?s:[^\\{q}]|\\.)*+{q}(?!\w)")]
    for q in "\"'`"
} | {q * 3: [re.compile(rf"(?s:[^\\{q}]|\\.|{q}(?!{q}{q}))*+{q}{q}{q}")] for q in "\"'"}
_JOINED = re.compile(r"""\x20*\+\x20*(?:(["'])((?:\\.|(?!\1)[^\\\n])*+)\1|([A-Za-z_]\w*))""")
_BRACE = re.compile(r"[{}]")
_OBJECT = re.compile(r"\s*\{")
_LINE_END = re.compile(r"[ \t]*\r?\n")
_PHRASE = re.compile(r"[A-Za-z]+(?:[-_./][A-Za-z]+)+\Z")
_NAME = re.compile(r"([A-Za-z_]\w*)\Z")
_REFERENCE = re.compile(r"\$\{?([A-Za-z_]\w*)\}?\Z")
_QUOTES = ("\"", "'", "`")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PLACEHOLDER = re.compile(
    r"(?i)(?:.*(?:example|changeme|placeholder|your[-_]|dummy|xxxx|redacted|<[^>]*>)|true|false|null|none|test|\*+|\d{1,6})\Z"
)


def name_weight(name: str) -> float:
    """0 to 1: how sensitive a target name is, by its words and neighbouring pairs of words."""
    words = [w.lower() for w in _PARTS.findall(name)]
    pairs = [f"{a}_{b}" for a, b in zip(words, words[1:])]
    return max((SENSITIVE.get(w, 0.0) for w in [*words, *pairs]), default=0.0)


def literal_weight(value: str) -> float:
    """0 to 1: how much a literal looks like key material (length, entropy, kinds of characters).

    White space separates the words of a passphrase or the lines of a key and counts as nothing.
    """
    if _PLACEHOLDER.match(value):
        return 0.0
    value = "".join(value.split())
    if len(value) < 8:
        return 0.0
    counts = Counter(value).values()
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts)
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w]"))
    return min(1.0, entropy / 4) * (0.7 + 0.1 * min(kinds, 3))


class _Names:
    """What encloses the targets of a text: braces of a named object, or lines indented below a name."""

    def __init__(self, text: str):
        self.text, self.at, self.line, self.last = text, 0, 0, -1
        self.braces: list[str] = []
        self.opening = ""  # the name whose object the next brace opens
        self.indented: list[tuple[int, str]] = []

    def enter(self, m: re.Match) -> str:
        """The name that encloses the target ``m``, in order of the targets; empty if none does."""
        text, start = self.text, m.start()
        for brace in _BRACE.finditer(text, self.at, max(self.at, start)):
            if brace[0] == "{":
                self.braces.append(self.opening or (self.braces[-1] if self.braces else ""))
            elif self.braces:
                self.braces.pop()
            self.opening = ""
        newline = text.rfind("\n", max(0, self.last), start)
        if newline >= 0 or self.last < 0:
            self.line = newline + 1
            if not text[self.line : start].strip(" \t-"):
                while self.indented and self.indented[-1][0] >= start - self.line:
                    self.indented.pop()
        self.last, self.opening = start, ""
        return self.braces[-1] if self.braces else self.indented[-1][1] if self.indented else ""

    def leave(self, m: re.Match, at: int | None) -> None:
        """``at`` is where the value of ``m`` ends; None for a target without one."""
        self.at = max(self.at, at or m.end())
        if at is None:
            if _OBJECT.match(self.text, m.end()):
                self.opening = m["name"]
            elif _LINE_END.match(self.text, m.end()):
                self.indented.append((m.start() - self.line, m["name"]))


def _later(places: list[int], i: int) -> int | None:
    """Of the definitions of a name, the last one before ``i``, else the first one after it."""
    k = bisect_right(places, i - 1)
    if k:
        return places[k - 1]
    return next((p for p in places[k : k + 2] if p != i), None)


def assignments(text: str) -> Iterator[tuple[str, int, int, str, tuple[Span, ...]]]:
    """(name, start, end, value, literals) of the assignments whose value is known.

    ``start`` and ``end`` bound the value as written.  A bare value that names a constant of the
    text, or a value that refers to it as $NAME, takes that constant's value, be it defined before or
    (failing that) after; sums of literals and constants are joined.  ``literals`` bound the
    literals that the value comes from, wherever they stand; ``value`` has them whole.  In "label: name = value" the value is given for the label too; a value
    that holds assignments is given, and so are they.  A neutral name inside a named object (in
    braces or indented below it) is given as "outer.name".
    """
    if "=" not in text and ":" not in text:
        return
    targets = list(_TARGET.finditer(text))
    defined = {m["name"] for m in targets}
    names = _Names(text)
    found: list[tuple[list[str], int, int, list[Span | str]]] = []
    places: dict[str, list[int]] = {}
    labels: list[str] = []  # targets whose value is the target of the next assignment
    bare = (0, 0)  # the last bare word
    for m, after in zip(targets, [*targets[1:], None]):
        outer = names.enter(m)
        start, parts, at = m.end(), [], None
        if opening := _OPENING.match(text, start):
            closings = (c.match(text, opening.end()) for c in _CLOSING[opening[1]])
            if closing := next((c for c in closings if c), None):
                start, at = opening.end(), closing.end()
                end = at - len(opening[1])
        else:
            if not bare[0] <= start < bare[1] and (word := _BARE.match(text, start)):
                bare = word.span()
            if bare[0] <= start < bare[1]:
                at = end = bare[1]
                whole = after and after.start() == start and after.end("name") >= end - (text[end - 1] == ":")
                if whole and _VALUE.match(text, after.end()):
                    labels.append(m["name"])
                    continue
                if (named := _NAME.match(text, start, end)) and named[1] in defined:
                    parts = [named[1]]
        names.leave(m, at)
        if at is None:
            labels = []
            continue
        if (named := _REFERENCE.match(text, start, end)) and named[1] in defined:
            parts = [named[1]]
        parts += [(start, end)]  # stands where the name before it leads nowhere
        while joined := _JOINED.match(text, at):
            if not joined[1] and joined[3] not in defined:
                break
            parts.append(joined.span(2) if joined[1] else joined[3])
            at = end = joined.end()
        places.setdefault(m["name"], []).append(len(found))
        own = f"{outer}.{m['name']}" if outer and m["name"].lower() in NEUTRAL else m["name"]
        found.append(([*labels, own], start, end, parts))
        labels = []

    resolved: dict[int, tuple[Span, ...]] = {}

    def literals(i: int) -> tuple[Span, ...]:
        stack = [i]
        while stack:
            here = stack[-1]
            if here in resolved and resolved[here]:
                stack.pop()
                continue
            resolved.setdefault(here, ())  # a constant that leads back to itself adds nothing
            leads = {p: _later(places[p], here) for p in found[here][3] if isinstance(p, str) and p in places}
            waiting = [k for k in leads.values() if k is not None and k not in resolved]
            if waiting:
                stack += waiting
                continue
            parts, spans = found[here][3], []
            for n, p in enumerate(parts):
                if isinstance(p, str):
                    spans += resolved.get(leads.get(p), ())
                elif n != 1 or not isinstance(parts[0], str) or not spans:
                    spans.append(p)
            resolved[here] = tuple(dict.fromkeys(spans))
            stack.pop()
        return resolved[i]

    values: dict[tuple[Span, ...], str] = {}  # each put together once, however many references lead to it
    for i, (given, start, end, _) in enumerate(found):
        scored = len(given) > 1 or name_weight(given[0])
        spans = literals(i) if scored else ((start, end),)
        value = ""
        if scored:
            if spans not in values:
                values[spans] = "".join(text[a:b] for a, b in spans)
            value = values[spans]
        for name in given:
            yield name, start, end, value, spans


def scan(text: str, operands: bool = False) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the secrets in ``text``, by start, then kind; code points.

    Base kinds score 1.  ``lexed`` literals score name_weight * literal_weight, and are given unless
    wholly inside a base span.  A reference gives the literals that it resolves to.  A sum is one
    span as written; ``operands`` also gives the literals of the constants in it.
    """
    spans: list[tuple[str, int, int, float]] = []
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        spans += [("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    spans += [("hex", *m.span(), 1.0) for m in HEX.finditer(text)]
    base = sorted((start, end) for _, start, end, _ in spans)
    starts, reach = [a for a, _ in base], [-1, *accumulate((b for _, b in base), max)]
    lexed: dict[Span, float] = {}
    weights: dict[str, float] = {}
    for name, start, end, value, literals in assignments(text):
        score = name_weight(name)
        unquoted = len(literals) == 1 and text[literals[0][0] - 1 : literals[0][0]] not in _QUOTES
        if unquoted and _PHRASE.match(value):
            continue  # plain words joined by hyphens, points or slashes, such as a name or a path
        if score and value not in weights:
            weights[value] = literal_weight(value)
        if score and (score := score * weights[value]) >= LEAST_SCORE:
            inside = [s for s in literals if start <= s[0] and s[1] <= end]
            away = [s for s in literals if s not in inside]
            for span in [*([(start, end)] if inside else []), *(away if operands or not inside else [])]:
                lexed[span] = max(score, lexed.get(span, 0.0))
    spans += [("lexed", *s, score) for s, score in lexed.items() if reach[bisect_right(starts, s[0])] < s[1]]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and ``secrets``: array of (kind, start, end, score) of every whole text.

    Null and empty texts have none; repeated rows are scanned alike; an empty table gives no rows;
    other columns are ignored.
    """
    small_batches(docs.sparkSession)
    span = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [dict(zip(("kind", "start", "end", "score"), s)) for s in scan(t or "", operands=True)]
                for t in batch.column("_text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, span)], names=["doc_id", "secrets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").alias("_text"))
    return rows.mapInArrow(
        run, f"doc_id {kind}, secrets array<struct<kind:string,start:int,end:int,score:double>>"
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mask``; all rows and columns stay.

    Overlapping spans are replaced once, from the first start to the last end.  A null text stays
    null.  Other columns are unchanged, whatever their names.
    """
    small_batches(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        if text is None or not (spans := scan(text, operands=True)):
            return text
        out, at, until = [], 0, -1
        for _, start, end, _ in spans:
            if start >= until:
                out += [text[at:start], mask]
            until = at = max(until, end)
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t) for t in batch.column("_text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts, batch.column("row")], names=["_text", "row"])

    rows, schema, name = text_beside_row(docs)
    masked = rows.mapInArrow(run, schema)
    return masked.select(*(F.col("_text").alias(c) if c == name else F.col("row")[c].alias(c) for c in docs.columns))


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns of ``find_secrets``' rows, computed from the spans."""
    joined = lambda kinds: F.array_join(
        F.transform(
            F.filter("secrets", lambda s: s["kind"].isin(*kinds)),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(KINDS[:3]), 256).alias("base_sha256"),
        joined(KINDS).alias("spans"),
    )


