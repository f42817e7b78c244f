"""Pluggable text scorers: the caller brings a model, Spark brings the rows that need it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonx, score
from ..functions.normalize import category as to_category
from .datasets import field_prompt, prompt

#: How sure a model's answer is.
MODEL_CONFIDENCE = 0.7
Factory = Callable[[], Callable[[list[str]], list[str]]]


def score_texts(df: DataFrame, prompt_col: str, factory: Factory, out_col: str = "response") -> DataFrame:
    """Adds the model's answer to each prompt. The factory runs once a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            model = model or factory()
            yield batch.assign(**{out_col: model(batch[prompt_col].tolist())})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())]))


def answers(prompts: Column, factory: Factory) -> Column:
    """The model's answers to each row's prompts, in their order; null where there are none. The factory runs once a partition, and only if a row has a prompt.

    A column, so that the rest of the row stays where it is: no copy of the table and no join.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for batch in batches:
            asked = [[] if p is None else list(p) for p in batch]
            flat = [x for p in asked for x in p]
            if flat:
                model = model or factory()
            said = iter(model(flat) if flat else [])
            yield pd.Series([[next(said) for _ in p] or None for p in asked], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(prompts)


def enrich(df: DataFrame, key: str, text_col: str, factory: Factory, fields: list[str]) -> DataFrame:
    """Only rows that lack fields go to the model; its answers fill null fields and keep the rest."""
    cols = {f: F.col(f) for f in score.WEIGHTS}
    prompts = F.when(score.needs_enrichment(cols) & F.col(text_col).isNotNull(), F.array(F.col(text_col)))
    said = df.withColumn("__said", answers(prompts, factory))
    parsed = said.withColumn("__v", jsonx.parse(F.element_at("__said", 1)))
    found = jsonx.validated(F.col("__v"))
    return parsed.select(*[F.coalesce(c, found[c]).alias(c) if c in fields else F.col(c) for c in df.columns])


def enrich_by_field(df: DataFrame, key: str, text_col: str, factory: Factory, fields: tuple[str, ...] = ("merchant", "category", "date", "reference"), required: tuple[str, ...] = ("amount", "type")) -> DataFrame:
    """Rows that lack fields ask the model for each lacking one of ``fields``, and, where a required field lacks, for the whole object.

    Answers fill null fields only; ``meta`` maps each filled field to the model's confidence. A field that the model
    does not know stays null, and rows that lack nothing are never sent.
    """
    text = F.col(text_col)
    ask = lambda name, on, words: F.when(on, F.struct(F.lit(name).alias("field"), words.alias("prompt")))
    lacks = [F.col(f).isNull() for f in required]
    asks = F.array_compact(F.array(*[ask(f, F.col(f).isNull(), field_prompt(f, text)) for f in fields], ask("*", F.array_contains(F.array(*lacks), True), prompt(text))))
    lacking = score.needs_enrichment({f: F.col(f) for f in score.WEIGHTS}) & text.isNotNull()
    asked = df.withColumn("__asks", F.when(lacking & (F.size(asks) > 0), asks))
    said = asked.withColumn("__said", answers(F.transform("__asks", lambda a: a["prompt"]), factory))
    # The answers stand in the order of the prompts.
    of = F.map_from_arrays(F.transform("__asks", lambda a: a["field"]), F.col("__said"))
    said = said.withColumn("__of", of).withColumn("__v", jsonx.parse(F.try_element_at("__of", F.lit("*"))))
    whole = jsonx.validated(F.col("__v"))
    alone = {f: jsonx.single_field(F.try_element_at("__of", F.lit(f))) for f in fields}
    one = lambda f: F.when(F.map_contains_key("__of", f), to_category(alone[f])) if f == "category" else alone[f]
    joined = said.select(*df.columns, *[F.coalesce(one(f), whole[f]).alias(f"__{f}") for f in fields], *[whole[f].alias(f"__{f}") for f in required])
    names = [*fields, *required]
    filled = F.map_filter(F.create_map(*[x for f in names for x in (F.lit(f), F.when(F.col(f).isNull() & F.col(f"__{f}").isNotNull(), F.lit(MODEL_CONFIDENCE)))]), lambda _, v: v.isNotNull())
    return joined.select(*[F.coalesce(c, F.col(f"__{c}").cast(df.schema[c].dataType)).alias(c) if c in names else F.col(c) for c in df.columns], filled.alias("meta"))
