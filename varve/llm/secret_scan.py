"""Secrets in text: fixed patterns, and literals that flow to sensitive names.

Three patterns always count (see BASE). Beside them an assignment-aware lexer
reads source and configuration syntax (`name = "literal"`, `name: literal`,
`"name": "literal"`, `export NAME=literal`), follows constants through names
(`a = "..."`, `password = a`, `key = a + "..."`) and scores each literal by
the names it reaches and by how random it looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import ship, with_text

# --- fixed values: the base patterns, in the order of their kinds
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are taken whole, so this is [0-9a-f]+ of 16 or more
#: How sensitive the words of a name are, 0 to 1.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "credential": 0.9, "credentials": 0.9,
    "apikey": 1.0, "token": 0.9, "bearer": 0.8, "auth": 0.7, "authorization": 0.7, "signature": 0.5, "salt": 0.5, "dsn": 0.5,
}
#: Pairs of neighbouring words that are sensitive together.
SENSITIVE_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("signing", "key"), ("encryption", "key"), ("master", "key"), ("account", "key")}
PLACEHOLDERS = re.compile(r"(?i)^(?:your|my|example|change|insert|todo|none|null|true|false|test|dummy|sample|redacted|x{4,}|\*+|<|\$\{|\{\{|%\()")
# --- end of fixed values
#: A literal counts from this score, and from this length.
LEAST_SCORE, LEAST_LENGTH = 0.6, 8

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_WORD_NAME = r"[0-9.\-]*+(?P<name>[A-Za-z_$][A-Za-z0-9_$.\-]*+)"
_ASSIGNED = (
    r"""\x20*(?::=|=>|=(?![=~])|:(?![:/]))\x20*(?P<value>"""
    r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[^\s"',;+]+)(?:\x20*\+\x20*(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[A-Za-z_][A-Za-z0-9_.]*))*)"""
)
#: A name without quotes starts with its run of characters, so a long run is gone through once.
_STATEMENT = re.compile(rf"""(?:(?<![A-Za-z0-9_$.\-]){_WORD_NAME}|(?P<quoted>"[^"\n]++"|'[^'\n]++')){_ASSIGNED}""")
#: The same where the last statement ended within a run.
_REST = re.compile(_WORD_NAME + _ASSIGNED)
_TERM = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([^\s"',;+]+)""")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*\Z")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def sensitivity(name: str) -> float:
    """How much a name suggests that its value is a secret."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    return max(best, 0.9 if any(pair in SENSITIVE_PAIRS for pair in zip(parts, parts[1:])) else 0.0)


def randomness(counts: dict[str, float]) -> float:
    """0 to 1 from the entropy of characters and the kinds of characters mixed."""
    n, characters = sum(counts.values()), "".join(counts)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values() if c)
    kinds = sum(bool(re.search(p, characters)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 4) * min(1.0, (1 + kinds) / 3)


def _statements(text: str) -> Iterator[tuple[str, tuple[int, int]]]:
    """(name, span of the value) of each assignment."""
    at = 0
    while found := _STATEMENT.search(text, at):
        while found:
            yield found["name"] or found["quoted"].strip("\"'"), found.span("value")
            at = found.end()
            found = _REST.match(text, at)


class Values:
    """Concatenated values of names: each is a list of spans and of earlier values, which are shared.

    What is asked of a value is worked out once, from its pieces, so chains of
    any length and values that double themselves take no more than their text.
    """

    #: Characters that decide whether a value is a placeholder; counts beyond the square of HEAVY are divided by it.
    START, HEAVY = 16, 1e100

    def __init__(self, text: str) -> None:
        self.text = text
        self.pieces: list[list[tuple[int, int] | int]] = []
        self.known: dict[int, tuple[str, dict[str, float]]] = {}
        self.reported: set[int] = set()

    def add(self, pieces: list[tuple[int, int] | int]) -> int:
        self.pieces.append(pieces)
        return len(self.pieces) - 1

    def summary(self, value: int) -> tuple[str, dict[str, float]]:
        """The first characters, and how often each character occurs."""
        todo = [value]
        while todo:
            if (of := todo[-1]) in self.known:
                todo.pop()
            elif missing := [p for p in self.pieces[of] if isinstance(p, int) and p not in self.known]:
                todo += missing
            else:
                start, counts = "", {}
                for piece in self.pieces[of]:
                    first, more = self.known[piece] if isinstance(piece, int) else (self.text[piece[0] : min(piece[1], piece[0] + self.START)], Counter(self.text[piece[0] : piece[1]]))
                    start = (start + first)[: self.START] if len(start) < self.START else start
                    for c, n in more.items():
                        counts[c] = counts.get(c, 0) + n
                if sum(counts.values()) > self.HEAVY**2:
                    counts = {c: n / self.HEAVY for c, n in counts.items()}
                self.known[of] = start, counts
        return self.known[value]

    def report(self, value: int) -> Iterator[tuple[int, int]]:
        """All spans of a value that no earlier call gave."""
        todo = [value]
        while todo:
            if (of := todo.pop()) not in self.reported:
                self.reported.add(of)
                todo += [p for p in self.pieces[of] if isinstance(p, int)]
                yield from (p for p in self.pieces[of] if not isinstance(p, int) and p[0] < p[1])


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name with a good score."""
    if "=" not in text and ":" not in text:
        return []
    values = Values(text)
    known: dict[str, int] = {}
    found: set[tuple[int, int]] = set()
    for name, span in _statements(text):
        pieces: list[tuple[int, int] | int] = []
        for term in _TERM.finditer(text, *span):
            if term[3] is None:
                pieces.append(term.span(1) if term[1] is not None else term.span(2))
            elif _NAME.match(term[3]) and term[3] in known:
                pieces.append(known[term[3]])
            elif len(term[3]) >= LEAST_LENGTH and re.search(r"[0-9]", term[3]):
                pieces.append(term.span(3))  # configuration without quotes
        known[name] = value = values.add(pieces)
        if not (weight := sensitivity(name)):
            continue
        start, counts = values.summary(value)
        if sum(counts.values()) >= LEAST_LENGTH and not PLACEHOLDERS.match(start) and not re.search(r"\s", "".join(counts)) and weight * (0.4 + 0.6 * randomness(counts)) >= LEAST_SCORE:
            found.update(values.report(value))
    return sorted(found)


def scan(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans, by start, then kind as in KINDS."""
    found = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for a, _, b in found)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    # some base span holds a literal if those that start before it reach its end
    found += [(a, "literal", b) for a, b in literals(text) if not (k := bisect_right(starts, a)) or reach[k - 1] < b]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def redact(text: str, mark: str = "[REDACTED]") -> str:
    """The text with every secret replaced; of an assignment only its value."""
    spans = []
    for start, kind, end in scan(text):
        spans.append((ASSIGN.match(text, start).start(2) if kind == "assign" else start, end))
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row.

    Null and empty texts have no spans (the sha256 is that of nothing).
    Offsets count code points. Rows are independent: repeated rows repeat
    their result, other columns are not looked at, and an empty table gives an
    empty result. A text is scanned whole, in time that grows with its length.
    """
    ship(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [scan(t) for t in batch["text"]]
            kinds = [Counter(s[1] for s in spans) for spans in found]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                **{f"n_{k}": [c[k] for c in kinds] for k in KINDS[:3]},
                "base_sha256": [hashlib.sha256(_joined([s for s in spans if s[1] != "literal"]).encode()).hexdigest() for spans in found],
                "spans": [_joined(spans) for spans in found],
            })

    texts = with_text(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInPandas(rows, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the secrets of `text` replaced; null stays null."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t) if isinstance(t, str) else None)

    return docs.withColumn(text_col, clean(F.col(text_col)))
