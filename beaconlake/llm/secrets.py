"""Secrets in texts: plain patterns, and literals that are assigned to sensitive names."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.base import bounded_batches, table
from beaconlake.llm.spans import Span, find_spans

BASE, ADDED = ("assign", "access", "hex"), ("literal",)
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A run that is too short holds no match that is long enough, so both need no second look.
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24,}")

_OPERATOR = re.compile(r":=|=>|\+=|==+|!=|<=|>=|[:=]")
_NAME_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-$")
#: A string in triple quotes or back quotes, over lines; one of either quote, on one line; all with escapes; or a bare word.
_VALUE = re.compile(
    r"""[ \t]*+(?:\"{3}((?:[^"\\]|\\(?s:.)|"(?!""))*+)\"{3}|'{3}((?:[^'\\]|\\(?s:.)|'(?!''))*+)'{3}|`((?:[^`\\]|\\(?s:.))*+)`"""
    r"""|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|([A-Za-z0-9+/_.=$-]++))""")
_LONG, _WORD = 3, 6  # the groups up to _LONG run over lines, _WORD is the bare word
_TYPE_NAME = r"""[A-Za-z_$][A-Za-z0-9_.$]*+(?:::[A-Za-z0-9_$]++)*+(?:[<\[][A-Za-z0-9_.,:|&*?<>\[\]'\x20]{0,200}[>\]])?[?!*]*+"""
#: A type between the colon behind a name and the sign of the assignment.
_TYPE = re.compile(rf"""[ \t]*+(?:&[ \t]*+)?(?:'[a-z_]++[ \t]++)?(?:mut[ \t]++)?({_TYPE_NAME}(?:[ \t]*+[|&][ \t]*+{_TYPE_NAME})*+)[ \t]*+=(?![=>])""")
#: Types seldom hold a digit before a letter; what does is read as a value too.
_NO_TYPE = re.compile("[0-9][A-Za-z]")
_PLUS = re.compile(r"[ \t]*+\+[ \t]*+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: How much a word in a name says that its value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.8, "credential": 0.9, "credentials": 0.9,
             "apikey": 0.9, "bearer": 0.8, "auth": 0.6, "key": 0.5, "private": 0.5, "signature": 0.5}
PAIRS = {("api", "key"): 0.9, ("access", "key"): 0.9, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("encryption", "key"): 0.9, ("signing", "key"): 0.9}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "none", "null", "true", "false", "todo", "redacted", "$")
LEAST_SCORE, LEAST_LENGTH = 0.5, 6
#: Bits of a value at which its score is 1; most characters of a placeholder that lie on one side of a seam.
FULL, EDGE = 36.0, max(map(len, PLACEHOLDERS)) - 1


def name_score(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    single = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    return max([single, *(PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False))])


class Value:
    """What is known of a literal, or of the sum of some: its length, how often each of its bytes occurs, whether
    it holds a placeholder, and its ends, in which one may begin or stop. A value that reaches FULL bits stays
    full whatever is added to it, so its bytes are counted no longer: a value's size is bounded."""

    __slots__ = ("length", "counts", "placeholder", "head", "tail")

    def __init__(self, text: str = ""):
        low = text.lower()
        self.length, self.counts = len(text), _open(Counter(text.encode("utf-8", "surrogatepass")))
        self.placeholder, self.head, self.tail = any(p in low for p in PLACEHOLDERS), low[:EDGE], low[-EDGE:]

    def __add__(self, other: Value) -> Value:
        out = Value.__new__(Value)
        out.length = min(self.length + other.length, 1 << 32)
        out.counts = None if self.counts is None or other.counts is None else _open(self.counts + other.counts)
        seam = self.tail + other.head
        out.placeholder = self.placeholder or other.placeholder or any(p in seam for p in PLACEHOLDERS)
        out.head, out.tail = (self.head + other.head)[:EDGE], (self.tail + other.tail)[-EDGE:]
        return out

    def score(self) -> float:
        """0 to 1: by length and by how evenly signs are used; placeholders count little."""
        if self.length < LEAST_LENGTH:
            return 0.0
        bits = FULL if self.counts is None else _bits(self.counts)
        return min(1.0, 0.4 + bits / 60) * (0.2 if self.placeholder else 1.0)


def _bits(counts: Counter) -> float:
    n = counts.total()
    return -sum(c * math.log2(c / n) for c in counts.values())


def _open(counts: Counter) -> Counter | None:
    """The counts, none of a full value. Adding values never lowers their bits."""
    return None if _bits(counts) >= FULL else Counter({k: min(c, 1 << 32) for k, c in counts.items()})


def _name_before(text: str, at: int, least: int) -> str:
    """The name that an operator at ``at`` assigns to, not reaching before ``least``."""
    while at > least and text[at - 1] in " \t":
        at -= 1
    while at > least and text[at - 1] in "\"']":
        at -= 1
    end = at
    while at > least and text[at - 1] in _NAME_SIGNS:
        at -= 1
    return text[at:end]


def assignments(text: str):
    """(name, parts, adds) of each assignment; a part is (value, start, end, quoted) of a literal or word,
    adds says that it is joined to the name's value.

    Reads ``name = value``, ``name: value``, ``"name": "value"``, ``name := value``, ``name => value``,
    ``name += value``, ``name: type = value`` and sums of strings; comparisons are none. A value in triple or
    back quotes may be a text with assignments, which are read too. The last word before ``=`` in
    ``name: word = value`` counts as a name as well if it is a sensitive one, as in ``else: key = value``.
    """
    past = 0
    for op in _OPERATOR.finditer(text):
        if op[0] not in (":", "=", ":=", "=>", "+=") or op.start() < past:
            continue
        name = _name_before(text, op.start(), past)
        if not name:
            continue
        names, value = [name], None
        typed = _TYPE.match(text, op.end()) if op[0] == ":" else None
        if typed and (value := _VALUE.match(text, typed.end())):
            if _NO_TYPE.search(typed[1]):
                yield name, [(typed[1], typed.start(1), typed.end(1), False)], False
            names += [typed[1]] if name_score(typed[1]) else []
        value = value or _VALUE.match(text, op.end())
        parts, inner = [], None
        while value:
            k = value.lastindex
            parts.append((value[k], value.start(k), value.end(k), k < _WORD))
            inner = value.start(k) if inner is None and k <= _LONG else inner
            past = value.end() if inner is None else inner
            plus = _PLUS.match(text, value.end())
            value = _VALUE.match(text, plus.end()) if plus else None
        if parts:
            for n in names:
                yield n, parts, op[0] == "+="


def secret_literals(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals whose value reaches a sensitive name, directly or through
    names of constants.

    A name's value is the sum of the literals and names assigned to it, as they are there; what is added to a
    name counts by itself and as a part of the whole. A sensitive name gives its value a score, and a literal
    has the best one of all values that it is part of. Values know what they were made of, and that was made
    before them: one walk backwards hands the scores down, however often names are added to each other.
    """
    made: list[tuple[int, ...]] = []  # for each value the values it was made of
    spans: list[tuple[int, int] | None] = []
    best: list[float] = []
    known: dict[str, tuple[int, Value]] = {}

    def put(of: tuple[int, ...], span: tuple[int, int] | None) -> int:
        made.append(of), spans.append(span), best.append(0.0)
        return len(made) - 1

    def joined(parts: list[tuple[int, Value]]) -> tuple[int, Value]:
        return parts[0] if len(parts) == 1 else (put(tuple(dict.fromkeys(i for i, _ in parts)), None), reduce(add, (v for _, v in parts)))

    for name, parts, adds in assignments(text):
        value = joined([known[v] if not quoted and v in known else (put((), (start, end)), Value(v)) for v, start, end, quoted in parts])
        weight = name_score(name)
        if weight:
            best[value[0]] = max(best[value[0]], weight * value[1].score())
        if adds and name in known:
            value = joined([known[name], value])
            if weight:
                best[value[0]] = max(best[value[0]], weight * value[1].score())
        known[name] = value
    found: dict[tuple[int, int], float] = {}
    for i in range(len(made) - 1, -1, -1):
        if best[i] < LEAST_SCORE:
            continue
        for k in made[i]:
            best[k] = max(best[k], best[i])
        if spans[i] and spans[i][0] < spans[i][1]:
            found[spans[i]] = max(best[i], found.get(spans[i], 0.0))
    return [(s, e, x) for (s, e), x in found.items()]


def base_spans(text: str) -> list[Span]:
    spans = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return spans + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def outside(literals: list[tuple[int, int, float]], spans: list[Span]) -> list[Span]:
    """The literals that lie in none of the spans, by start; both are sorted once and read side by side."""
    spans, at, reach, left = sorted((a, b) for _, a, b in spans), 0, -1, []
    for s, e, _ in sorted(literals):
        while at < len(spans) and spans[at][0] <= s:
            reach = max(reach, spans[at][1])
            at += 1
        if e > reach:
            left.append(("literal", s, e))
    return left


def scan(text: str) -> tuple[list[Span], list[Span], float]:
    """Base spans, literals that no base span covers, and the highest score of a literal."""
    own, literals = base_spans(text), secret_literals(text)
    return own, outside(literals, own), max((x for *_, x in literals), default=0.0)


def redact(text: str, mask: str = "[REDACTED]") -> str:
    """The text with every secret value masked; the names that values are assigned to stay."""
    cuts = [(m.start(1), m.end(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    cuts += [(s, e) for k, s, e in base_spans(text) if k != "assign"] + [(s, e) for s, e, _ in secret_literals(text)]
    out, at = [], 0
    for s, e in sorted(cuts):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and score of every text.

    spans holds the base spans and, as kind literal, those that the assignment lexer adds. A null text
    counts as empty: no spans, the digest of an empty string, score 0. Texts are read whole, in one pass
    for each pattern. Ids may be null or repeat, other columns are ignored, an empty table gives an empty result.
    """
    return find_spans(docs, scan, BASE, ADDED, id_col, text_col, "score")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with secret values masked in the text column; null stays null, all other columns stay."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(text_col, _masked(F.col(text_col)))


def _masked(text: Column) -> Column:
    def mask(column: pa.Array) -> pa.Array:
        return pa.array([t.as_py() and redact(t.as_py()) for t in column], pa.string())

    return F.arrow_udf(mask, "string")(text)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
