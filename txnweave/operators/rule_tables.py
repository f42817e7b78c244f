"""Keyword rules as data: labels of texts by tables of rules of any size.

A rule table has (ord, keyword, label, weight): a rule fires where its keyword
stands in the text (both as given: lower them if case is not to count). With a
``name``, it also fires where the text stands in the name. From the rules that
fire come the first by ``ord``, their number, and the label with the largest sum
of weights (ties: the label whose first rule comes first).

The rules are dealt to blocks of at most ``BLOCK_RULES`` rules and about
``BLOCK_BYTES`` bytes; a block is broadcast and becomes one keyword automaton in each
worker, so a text is read once a block however many rules there are, and only
the text goes to Python. No text is shuffled and no text meets a rule that it
doesn't hold. Results of blocks are merged as columns.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import written
from . import ranges

BLOCK_RULES = 200_000
BLOCK_BYTES = 16_000_000
#: Automata that a worker keeps.
KEPT = 4

_HIT = "struct<first: long, label: string, exact: long, exact_label: string, n: long, scores: array<struct<label: string, score: double, first: long>>>"


class Rules:
    """An automaton over the keywords, and an index of the names by their pieces of up to three characters."""

    GRAM = 3

    def __init__(self, rows: list[tuple[int, str, str, float, str | None]]):
        import ahocorasick

        self.rows = sorted(rows, key=lambda r: r[0])
        self.automaton = ahocorasick.Automaton()
        held: dict[str, list[int]] = {}
        self.everywhere = [i for i, r in enumerate(self.rows) if r[1] == ""]
        for i, r in enumerate(self.rows):
            if r[1]:
                held.setdefault(r[1], []).append(i)
        for keyword, numbers in held.items():
            self.automaton.add_word(keyword, numbers)
        if held:
            self.automaton.make_automaton()
        self.some = bool(held)
        self.grams: dict[str, list[int]] = {}
        for i, r in enumerate(self.rows):
            if r[4]:
                for g in {r[4][a : a + n] for n in range(1, self.GRAM + 1) for a in range(len(r[4]) - n + 1)}:
                    self.grams.setdefault(g, []).append(i)

    def fired(self, text: str) -> set[int]:
        out = set(self.everywhere)
        if self.some and text:
            for _, numbers in self.automaton.iter(text):
                out.update(numbers)
        if self.grams and text:
            pieces = [text[a : a + self.GRAM] for a in range(max(len(text) - self.GRAM + 1, 1))]
            few = min((self.grams.get(p, []) for p in pieces), key=len)
            out.update(i for i in few if text in self.rows[i][4])
        return out

    def judge(self, text: str | None) -> dict | None:
        if text is None:
            return None
        numbers = sorted(self.fired(text))
        if not numbers:
            return {"first": None, "label": None, "exact": None, "exact_label": None, "n": 0, "scores": []}
        same = next((self.rows[i] for i in numbers if self.rows[i][1] == text), None)
        scores: dict[str, list] = {}
        for i in numbers:
            at, _, label, weight, _ = self.rows[i]
            scores.setdefault(label, [0.0, at])[0] += weight
        exact = {"exact": same and same[0], "exact_label": same and same[2]}
        return {"first": self.rows[numbers[0]][0], "label": self.rows[numbers[0]][2]} | exact | {"n": len(numbers), "scores": [{"label": k, "score": s, "first": at} for k, (s, at) in scores.items()]}


_NOTHING = dict.fromkeys(("first", "label", "exact", "exact_label", "n", "scores"))
_built: dict[int, Rules] = {}


def _judge(shared, token: int) -> Callable[[Column], Column]:
    @F.pandas_udf(_HIT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        if token not in _built:
            while len(_built) >= KEPT:
                _built.pop(next(iter(_built)))
            _built[token] = Rules(shared.value)
        rules = _built[token]
        rows = [rules.judge(t) or _NOTHING for t in texts]
        out = pd.DataFrame(rows, columns=[*_NOTHING])
        return out.astype({"first": "Int64", "exact": "Int64", "n": "Int64"})

    return judge


_count = 0


def _blocks(rules: DataFrame) -> list[list[tuple]]:
    """The rules in blocks that the driver can hold, one after the other in their order."""
    columns = ["ord", "keyword", "label", "weight", "name"]
    rows = rules.select(F.col("ord").cast("long"), "keyword", "label", (F.col("weight") if "weight" in rules.columns else F.lit(1.0)).cast("double").alias("weight"), (F.col("name") if "name" in rules.columns else F.lit(None)).cast("string").alias("name"))
    rows = rows.where("keyword IS NOT NULL")
    size = F.coalesce(F.octet_length("keyword"), F.lit(0)) + F.coalesce(F.octet_length("label"), F.lit(0)) + F.coalesce(F.octet_length("name"), F.lit(0)) + 24
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    if total["n"] <= BLOCK_RULES and total["bytes"] <= BLOCK_BYTES:
        return [[tuple(r) for r in rows.collect()]]
    summed = ranges.prefix_sums(rows, [], [F.col("ord"), F.col("keyword")], {"__n": F.lit(1).cast("long"), "__bytes": size.cast("long")})
    dealt = written(summed.withColumn("__block", F.greatest(F.floor((F.col("__n") - 1) / BLOCK_RULES), F.floor(F.col("__bytes") / BLOCK_BYTES))), "rule-blocks")
    last = dealt.agg(F.max("__block")).first()[0]
    return [[tuple(r) for r in dealt.where(F.col("__block") == i).select(*columns).collect()] for i in range(last + 1)]


def with_rules(df: DataFrame, text_col: str, rules: DataFrame, *more: tuple[str, DataFrame]) -> DataFrame:
    """Adds first_rule, first_label, exact_label (of the first rule whose keyword is the text), n_rules, best_label and best_score; null texts get nulls, texts without rules 0 rules.

    ``more``: other texts with rules of their own, whose hits count with those of the first (a null text counts for nothing there);
    ord must then be one order over all tables.
    """
    global _count
    hits, out = [], df
    for column, table in ((text_col, rules), *more):
        for block in _blocks(table):
            name = f"__hit{len(hits)}"
            _count += 1
            out = out.withColumn(name, _judge(df.sparkSession.sparkContext.broadcast(block), _count)(F.col(column)))
            hits.append(F.col(name))
    first = F.array_min(F.array(*[F.when(h["first"].isNotNull(), F.struct(h["first"].alias("first"), h["label"].alias("label"))) for h in hits]))
    exact = F.array_min(F.array(*[F.when(h["exact"].isNotNull(), F.struct(h["exact"].alias("exact"), h["exact_label"].alias("label"))) for h in hits]))
    none = F.array().cast(_HIT[_HIT.index("array<") :].removesuffix(">"))
    scores = F.flatten(F.array(*[F.coalesce(h["scores"], none) for h in hits]))
    labels = F.array_distinct(F.transform(scores, lambda s: s["label"]))

    def summed(label: Column) -> Column:
        mine = F.filter(scores, lambda s: s["label"].eqNullSafe(label))
        return F.struct(F.aggregate(mine, F.lit(0.0), lambda a, s: a + s["score"]).alias("score"), (-F.array_min(F.transform(mine, lambda s: s["first"]))).alias("at"), label.alias("label"))

    best = F.array_max(F.transform(labels, summed))
    n = hits[0]["n"]
    for h in hits[1:]:
        n = n + F.coalesce(h["n"], F.lit(0))
    got = out.select(*df.columns, first.alias("__first"), exact.alias("__exact"), best.alias("__best"), n.alias("__n"))
    return got.select(*df.columns, F.col("__first.first").alias("first_rule"), F.col("__first.label").alias("first_label"), F.col("__exact.label").alias("exact_label"), F.col("__n").alias("n_rules"), F.col("__best.label").alias("best_label"), F.col("__best.score").alias("best_score"))


def keyword_table(spark: SparkSession, rules: dict[str, list[str]], weight: float = 1.0, start: int = 0) -> DataFrame:
    """(ord, keyword, label, weight) of rules label -> keywords, in their order."""
    rows = [(start + i, k, label, weight) for i, (label, k) in enumerate((label, k) for label, words in rules.items() for k in words)]
    return spark.createDataFrame(rows, "ord long, keyword string, label string, weight double")


def weighted_choice(df: DataFrame, group: list[str], u: Column, weights: DataFrame, buckets: int = 64) -> DataFrame:
    """Adds choice: of the rows of a weights table (group columns, choice, weight) the one on which u in [0, 1) falls.

    Each choice holds a part of [0, 1) in proportion to its weight, in the order of the choices. A choice stands in the
    buckets of [0, 1) that its part touches, so a row meets the one or two choices of its own bucket by an equal join, and
    a group that holds most rows is dealt over all buckets. Groups without weights get null; null equals null.
    """
    over = Window.partitionBy(*group).orderBy("choice")
    whole = Window.partitionBy(*group)
    w = weights.where("weight > 0").select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("choice").alias("__choice"), F.col("weight").cast("double").alias("__w"), *group, "choice")
    share = w.select("*", F.sum("__w").over(over).alias("__upto"), F.sum("__w").over(whole).alias("__all"), F.row_number().over(Window.partitionBy(*group).orderBy(F.col("choice").desc())).alias("__last"))
    lo, hi = (F.col("__upto") - F.col("__w")) / F.col("__all"), F.when(F.col("__last") == 1, 1.0).otherwise(F.col("__upto") / F.col("__all"))
    parts = share.select(*[f"__g_{g}" for g in group], "__choice", lo.alias("__lo"), hi.alias("__hi"))
    touched = F.sequence(F.floor(F.col("__lo") * buckets), F.least(F.floor(F.col("__hi") * buckets), F.lit(buckets - 1)))
    parts = parts.select("*", F.explode(touched).alias("__b"))
    rows = df.withColumn("__u", u).withColumn("__bucket", F.floor(F.col("__u") * buckets))
    same = (F.col("__bucket") == F.col("__b")) & (F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi"))
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    joined = rows.join(parts, same, "left")
    return joined.select(*[c for c in df.columns if c != "choice"], F.col("__choice").alias("choice"))
