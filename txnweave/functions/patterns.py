"""Column builders over rule lists."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, reduce
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters besides a-z and A-Z that a pattern's a-z match when case is ignored.
FOLDED = "İıſ\u212a"


def java(pattern: str, ignore_case: bool = True) -> str:
    """Rules are written for Unicode classes; Java needs to be told."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def _required(parsed) -> list[list[str]]:
    """What a text must contain to match: of each list, one string."""
    found, run = [], ""
    for op, arg in parsed:
        if op is C.LITERAL:
            run += chr(arg)
            continue
        if op is C.AT:
            continue
        if run:
            found.append([run])
            run = ""
        if op is C.SUBPATTERN:
            found += _required(arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            found += _required(arg[2])
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            found.append([chr(c) for _, c in arg])
        elif op is C.BRANCH:
            each = [_sharpest(_required(x))[:1] for x in arg[1]]
            if all(each):
                found.append([x for e in each for x in e[0]])
    return found + ([[run]] if run else [])


def _sharpest(found: list[list[str]]) -> list[list[str]]:
    """The lists with the longest strings first; of those, the shortest lists."""
    return sorted(found, key=lambda xs: (-min(map(len, xs)), len(xs)))


@cache
def required(pattern: str) -> tuple[tuple[str, ...], ...]:
    """At most two lists; a text that has no string of one of them can't match."""
    lists = [tuple(dict.fromkeys(xs)) for xs in _sharpest(_required(_parser.parse(pattern)))]
    return tuple(dict.fromkeys(lists))[:2]


def folded(text: Column) -> Column:
    """The text in lower case; null if it holds letters that only patterns without regard to case take for a-z."""
    ascii = F.octet_length(text) == F.length(text)
    return F.when(ascii | ~text.rlike(f"[{FOLDED}]"), F.lower(text))


def may_match(text: Column, pattern: str, ignore_case: bool, low: Column | None = None) -> Column | None:
    """Whether a text holds what the pattern needs: a search for a few strings spares most texts the pattern. None: no such strings.

    ``low``: the ``folded`` text, where it is a column already; without it, patterns that ignore case have no such search.
    """
    lists = required(pattern)
    if not lists:
        return None
    if not ignore_case:
        return reduce(Column.__and__, [_any(text, ws) for ws in lists])
    if low is None:
        return None
    there = [_any(low, tuple(dict.fromkeys(w.lower() for w in ws))) for ws in lists]
    return F.coalesce(reduce(Column.__and__, there), F.lit(True))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def first_match(text: Column, pattern: str, group: int = 1, ignore_case: bool = True, low: Column | None = None) -> Column:
    """The first match's group, null where nothing (or nothing but '') is found."""
    found = let(F.regexp_extract(text, java(pattern, ignore_case), group), lambda x: F.when(x != "", x))
    guard = may_match(text, pattern, ignore_case, low)
    return found if guard is None else F.when(guard, found)


def matches(text: Column, pattern: str, ignore_case: bool = True, low: Column | None = None) -> Column:
    """Whether the pattern is found; a text that lacks what it needs isn't searched."""
    hit, guard = text.rlike(java(pattern, ignore_case)), may_match(text, pattern, ignore_case, low)
    return hit if guard is None else guard & hit


def by_priority(text: Column, patterns: list[tuple[str, int]], ignore_case: bool = True, low: Column | None = None) -> Column:
    """Patterns by falling priority (stable): the first that matches anywhere wins."""
    ordered = sorted(patterns, key=lambda p: -p[1])
    return F.coalesce(*[first_match(text, p, 1, ignore_case, low) for p, _ in ordered])


def in_order(text: Column, patterns: list[str], ignore_case: bool = True, low: Column | None = None) -> Column:
    return by_priority(text, [(p, 0) for p in patterns], ignore_case, low)


def _branches(words: list[str]) -> str:
    """Any of the words as one pattern, common beginnings once. A word that goes on from another one adds nothing."""
    if not words or "" in words:
        return ""
    rest: dict[str, list[str]] = {}
    for w in words:
        rest.setdefault(w[0], []).append(w[1:])
    each = [re.sub(r"([^\w\s])", r"\\\1", c) + _branches(ws) for c, ws in rest.items()]
    return each[0] if len(each) == 1 else f"(?:{'|'.join(each)})"


def holds_any(text: Column, words: list[str]) -> Column:
    """``has_any`` for long lists: one search for all words, not one for each. First letters go in fives, so that most places of a text are passed by few comparisons."""
    firsts = sorted({w[:1] for w in words})
    if "" in firsts:
        return F.contains(text, F.lit(""))
    each = []
    for at in range(0, len(firsts), 5):
        some = firsts[at : at + 5]
        known = "".join(re.sub(r"([^\w\s])", r"\\\1", c) for c in some)
        each.append(f"(?=[{known}]){_branches([w for w in words if w[0] in some])}")
    return text.rlike("|".join(each))


def has_any(text: Column, words: list[str]) -> Column:
    """Whether a text contains any of the words, as substrings."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def _by_letters(patterns: list[str]) -> str:
    """Patterns side by side; those that begin with one letter are tried only where it stands."""
    rest: dict[str, list[str]] = {}
    for p in patterns:
        rest.setdefault(p[0] if re.match(r"[a-zA-Z](?![*+?{])", p) else "", []).append(p)
    return "(?:" + "|".join((f"(?={c})(?:{'|'.join(ps)})" if c else "|".join(ps)) for c, ps in rest.items()) + ")"


def matches_any(text: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """Whether any of the patterns is found. Where all begin at a word's bound, that is looked for first, and then the letter that they begin with; else, where case counts and every pattern needs a string, texts without these strings aren't searched."""
    begun = [p.removeprefix(r"\b") for p in patterns]
    if all(p.startswith(r"\b") and "|" not in p for p in patterns):
        return text.rlike(java(r"\b" + _by_letters(begun), ignore_case))
    hit = text.rlike(java("|".join(f"(?:{p})" for p in patterns), ignore_case))
    needs = [required(p) for p in patterns]
    if ignore_case or not all(needs):
        return hit
    pairs = dict.fromkeys((x, y) for lists in needs for x in lists[0] for y in (lists[1] if len(lists) > 1 else ("",)))
    there = F.exists(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in pairs]), lambda w: F.contains(text, w["x"]) & F.contains(text, w["y"]))
    return there & hit


def count_matching(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda n, p: n + matches(text, p, False).cast("int"), patterns, F.lit(0))


def first_label(text: Column, rules: dict[str, list[str]]) -> Column:
    """The first label any word of which the text contains; null without one."""
    out = None
    for label, words in rules.items():
        out = F.when(has_any(text, words), label) if out is None else out.when(has_any(text, words), label)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds columns that a generator makes: filters on them and what uses them several times don't repeat their work below."""
    made = df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in values.items()]))).alias("__once"))
    return made.select(*[F.col(c) for c in df.columns if c not in values], *[F.col(f"__once.{k}").alias(k) for k in values])


def strip(text: Column) -> Column:
    """Trims all white space, not blanks alone."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
