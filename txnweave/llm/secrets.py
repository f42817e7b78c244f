"""Secret scans by assignment-aware lexing.

Fixed patterns find key=value secrets, access keys and long hex runs (the base).
The lexer reads source and configuration syntax around them: an identifier, quoted
key or subscript, an assignment sign (=, :, :=, =>) and a value made of string literals, bare
words and references, joined by + or by standing next to each other; or an element <name>value</name>, or the first two
arguments of a call, name("key", value). Literals have one quote or three, these also over several lines. So every
literal gets the name that it is assigned to. Constants are propagated, through any number of names: a reference
or ${placeholder} stands for the literals that its name was given in the text
(the last definition before it, else the first after it). A value is
scored by its target name, how sensitive its parts are (``NAME_SCORES``), and by its own
shape: length, entropy, mixed characters; placeholders, prose and repeats of
the name count against it. Nothing is bounded: names, literals, parts and chains may have any length. From ``LIMIT`` on it is a secret, reported where the
literal stands (kind ``lexed``), unless a base span covers it; of a value in parts those under ``LEAST_PART``
characters are left out, if a longer one is there.

Each text is lexed alone, in time linear in its length: no shuffle.

Defined cases: null and empty texts have no spans; positions are code points, ends exclusive;
spans are ordered by start, then by kind as in ``KINDS``; repeated rows each get
their own row; an empty table gives an empty result; extra columns are kept or not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, small_batches

KINDS = ("assign", "access", "hex", "lexed")

# Fixed by the contract of the base.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How much a part of a name says about what it holds.
NAME_SCORES = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "apikey": 3.0, "credential": 3.0, "credentials": 3.0,
    "token": 2.5, "bearer": 2.5, "private": 2.0, "auth": 2.0, "access": 1.5, "signing": 1.5, "api": 1.5, "key": 1.5, "salt": 1.5, "pass": 2.0,
}
LIMIT = 5.0
LEAST_PART = 4
#: Without one of these no name has a score: the parts themselves, or apikey dealt over parts.
_HINTS = re.compile("|".join([*NAME_SCORES, "[^A-Za-z0-9]*+".join("apikey")]), re.IGNORECASE)
# Possessive: what follows never starts with what was taken, so nothing is tried twice.
_NAME = r"[A-Za-z_$][\w$.\-]*+"
_SIGN = r"[ \t]*+(?::=|=>|=(?![=>])|:(?![:/=]))"
# A key, quoted or not, perhaps a subscript (conf["key"] = ...), and the sign. In a=b=c and a:b:c only a is a key.
_KEY = rf"(?:(?<![\w$.\-=:]){_NAME}{_SIGN}|(?<=:){_NAME}[ \t]*+=(?![=>]))"
_TARGET = re.compile(rf"""(?:(["'`])({_NAME})\1(?:[ \t]*+\])?+{_SIGN}|(?={_KEY})({_NAME}){_SIGN})[ \t]*+""")
_CALL = re.compile(rf"""\(\s*+(["'`])({_NAME})\1\s*+,\s*+""")
_ELEMENT = re.compile(rf"""<(?:[\w.\-]++:)?+({_NAME})(?:[ \t][^<>]*+)?+>([^<]*+)(?=</)""")
# A bare literal goes on to a blank or bracket, or to where another key begins: no text is read for two values.
_STOP = r"""\s"'`,;(){}\[\]<>+"""
_BARE = rf"(?=[^{_STOP}])[\w$.\-]*+(?:(?:=|:(?!{_NAME}[ \t]*+=(?![=>]))|[^{_STOP}:=\w$.\-](?!{_NAME}{_SIGN}))[\w$.\-]*+)*+"
# Three quotes before one: an empty pair is no value where a third follows.
_TERM = re.compile(rf"""(\"{{3}}|'{{3}})((?:\\[\s\S]|(?!\1)[^\\])*+)\1|(["'`])((?:\\.|(?!\3)[^\\\n])*+)\3|\$\{{({_NAME})\}}|({_BARE})""")
_JOIN = re.compile(r"[ \t]*+\+[ \t]*+|[ \t]++(?=[\"'`])")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|-+|changeme|example|placeholder|todo|none|null|true|false|undefined|your[_\-]?.*|<.*>|\$\{.*\}|%.*%)$", re.IGNORECASE)
_WHOLE_NAME = re.compile(rf"^{_NAME}$")


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    score = sum(NAME_SCORES.get(p, 0.0) for p in set(parts))
    return min(4.0, max(score, 3.0 if "apikey" in "".join(parts) else 0.0))


class Shape:
    """What the score of a value needs to know; shapes of parts add up without their texts."""

    __slots__ = ("counts", "placeholder", "only")

    def __init__(self, counts: Counter, placeholder: bool, only: str | None):
        self.counts, self.placeholder, self.only = counts, placeholder, only

    @classmethod
    def of(cls, value: str) -> Shape:
        return cls(Counter(value), bool(_PLACEHOLDER.match(value)), value)

    @classmethod
    def joined(cls, parts: list[Shape]) -> Shape:
        if len(parts) == 1:
            return parts[0]
        counts: Counter = Counter()
        for x in parts:
            counts.update(x.counts)
        return cls(counts, all(x.placeholder for x in parts), None)

    def score(self, name: str) -> float:
        counts, n = self.counts, self.counts.total()
        if n < 6 or self.placeholder or (self.only is not None and self.only.lower() == name.lower()):
            return -10.0
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        letters = [c.isalpha() for c in counts]
        score = 1.0 if n >= 8 else 0.0
        score += 1.0 if entropy >= 3.0 else 0.0
        score += 1.0 if any(letters) and any(c.isdigit() for c in counts) else 0.0
        score -= 2.0 if any(c.isspace() for c in counts) else 0.0
        score -= 1.0 if all(letters) and all(c.islower() for c in counts) else 0.0
        return score


Term = tuple[str, int, int, bool]


def _terms(text: str, pos: int) -> list[Term]:
    """(text, start, end, reference?) of the parts of the value at ``pos``."""
    out: list[Term] = []
    while m := _TERM.match(text, pos):
        if m[1] or m[3]:
            at = 2 if m[1] else 4
            out.append((m[at], m.start(at), m.end(at), False))
        elif m[5]:
            out.append((m[5], m.start(5), m.end(5), True))
        else:
            bare = m[6].rstrip(".:")
            out.append((bare, m.start(6), m.start(6) + len(bare), bool(_WHOLE_NAME.match(bare))))
        join = _JOIN.match(text, m.end())
        if not join:
            break
        pos = join.end()
    return out


def lex(text: str) -> list[tuple[str, list[Term]]]:
    """(name, parts of its value) of each assignment and element, in the order of the text."""
    found = [(m.start(), m[2] or m[3], _terms(text, m.end())) for m in _TARGET.finditer(text)]
    found += [(m.start(), m[2], _terms(text, m.end())) for m in _CALL.finditer(text)]
    for m in _ELEMENT.finditer(text):
        value = m[2].strip()
        if value:
            start = m.start(2) + m[2].index(value)
            found.append((m.start(), m[1], [(value, start, start + len(value), bool(_WHOLE_NAME.match(value)))]))
    return [(name, terms) for _, name, terms in sorted(found, key=lambda x: x[0]) if terms]


def _sources(found: list[tuple[str, list[Term]]]) -> list[list[int | None]]:
    """For each part of each value the assignment that it refers to: the last before it, else the first after it."""
    given: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(found):
        given.setdefault(name.rpartition(".")[2], []).append(i)

    def source(value: str, i: int) -> int | None:
        places = given.get(value.rpartition(".")[2], [])
        at = bisect_left(places, i)
        if at:
            return places[at - 1]
        return next((j for j in places[:2] if j != i), None)

    return [[source(value, i) if reference else None for value, _, _, reference in terms] for i, (_, terms) in enumerate(found)]


def lexed_spans(text: str) -> set[tuple[int, int]]:
    """The literals that sensitive names are given, by themselves or through other names.

    Each assignment's shape is made once, those that it refers to first; a reference that
    leads back to itself stands for its own text. So the work is linear in what was lexed.
    """
    if not _HINTS.search(text):
        return set()
    found = lex(text)
    sources = _sources(found)
    shapes: list[Shape | None] = [None] * len(found)
    weights = [name_score(name) for name, _ in found]
    for root, weight in enumerate(weights):
        stack = [root] if weight > 0 and shapes[root] is None else []
        opened = set()
        while stack:
            i = stack[-1]
            wait = [] if i in opened else [j for j in sources[i] if j is not None and shapes[j] is None and j not in opened]
            opened.add(i)
            if wait:
                stack += wait
                continue
            stack.pop()
            if shapes[i] is None:
                for k, j in enumerate(sources[i]):
                    if j is not None and shapes[j] is None:
                        sources[i][k] = None
                shapes[i] = Shape.joined([Shape.of(value) if j is None else shapes[j] for (value, *_), j in zip(found[i][1], sources[i], strict=True)])
    spans, seen = set(), set()
    for root, (name, _) in enumerate(found):
        if weights[root] <= 0 or weights[root] + shapes[root].score(name) < LIMIT:
            continue
        stack, parts = [root], []
        while stack:
            i = stack.pop()
            if i in seen:
                continue
            seen.add(i)
            stack += [j for j in sources[i] if j is not None]
            parts += [(a, b) for (_, a, b, _), j in zip(found[i][1], sources[i], strict=True) if j is None and b > a]
        long = [(a, b) for a, b in parts if b - a >= LEAST_PART]
        spans.update(long or parts)
    return spans


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All (kind, start, end), in order."""
    if not text:
        return []
    spans = []
    low = text.lower()
    # Lower-casing only decides whether the pattern can match; it matches on the text itself.
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in spans)
    starts, reach = [a for a, _ in base], [*accumulate((b for _, b in base), max)]

    def covered(a: int, b: int) -> bool:
        at = bisect_right(starts, a)
        return at > 0 and reach[at - 1] >= b

    spans += [("lexed", a, b) for a, b in lexed_spans(text) if not covered(a, b)]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _scan(carry: int):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_spans(x.as_py())] for x in batch.column(0)]
            yield pa.record_batch([*batch.columns[1:], pa.array(spans, kind)], names=[*[f"c{c}" for c in range(carry)], "spans"])

    return run


def scan(spark: SparkSession, docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """The ``carry`` columns and __spans, an array of (kind, start, end)."""
    small_batches(spark)
    schema = T.StructType([*[T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)], T.StructField("spans", _SPAN)])
    given = docs.select(F.col(text_col), *[F.col(c) for c in carry]).toDF("text", *[f"c{i}" for i in range(len(carry))])
    return given.mapInArrow(_scan(len(carry)), schema).toDF(*carry, "__spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark, documents(spark, sf_dir), ["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("__spans", lambda s: s["kind"] != "lexed")), 256).alias("base_sha256"),
        joined(F.col("__spans")).alias("spans"),
    )
