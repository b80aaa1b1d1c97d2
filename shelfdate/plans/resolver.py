"""Tokens to date: one row in, one row out, without a shuffle.

The tokens of an image are one array, so that normalisation, candidates, scores, votes, ranking and override rules are
expressions over arrays within the row. Only gathering boxes into such arrays shuffles, once, by image_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import LabelConfig
from ..functions.text import shape
from ..operators.candidates import clean_tokens, held, hold, joined_triples, month_candidates, number_triples, scored, steps
from ..operators.overrides import override, rescue_shapes
from ..operators.ranking import best, ranked, voted

FIELDS = ("year", "month", "day", "final_date", "rule", "score", "margin", "dropped", "alts", "votes", "all_cands")


def tokens_from_boxes(boxes: DataFrame) -> DataFrame:
    """image_id and items: the texts and sources of each image's boxes in reading order."""
    items = F.array_sort(F.collect_list(F.struct(F.col("stage_ord"), F.col("box_seq"), F.col("text"), F.col("src"))))
    return boxes.groupBy("image_id").agg(F.transform(items, lambda x: F.struct(x["text"].alias("text"), x["src"].alias("src"))).alias("items"))


def resolve_core(df: DataFrame, texts: str, name: str, config: LabelConfig) -> DataFrame:
    """name: the result of the array of strings texts, without override rules. Wants _srcs."""
    df = clean_tokens(df, texts, config)
    df = month_candidates(df, config)
    df = number_triples(df, config)
    df = joined_triples(df)
    df = scored(df, config)
    return best(ranked(voted(df, config)), name)


def resolve_core_only(tokens: DataFrame, config: LabelConfig | None = None) -> DataFrame:
    """tokens and the result columns without shapes and override rules."""
    df = hold(tokens, _texts=F.transform("items", lambda x: F.coalesce(x["text"], F.lit(""))), _srcs=F.transform("items", lambda x: x["src"]))
    df = resolve_core(df, "_texts", "_result", config or LabelConfig())
    return df.select(*[F.col(f"`{c}`") for c in tokens.columns], *[F.col(f"_result.{f}").alias(f) for f in FIELDS])


@steps
def _shaped():
    items = F.coalesce("items", F.array().cast("array<struct<text:string,src:string>>"))
    yield held(_texts=F.transform(items, lambda x: shape(F.coalesce(x["text"], F.lit("")))), _srcs=F.transform(items, lambda x: x["src"]))


@steps
def _second_try():
    """The second try is for rows without a whole date; others hand it no tokens."""
    again = F.when(F.col("_base.final_date") == "NONE", F.transform("_texts", rescue_shapes)).otherwise(F.array().cast("array<string>"))
    yield held(_again=again, _joined=F.array_join("_texts", " "))


def resolve_dates(tokens: DataFrame, config: LabelConfig | None = None) -> DataFrame:
    """tokens and the result columns. tokens: items, array of text and src in reading order (null or empty: nothing is found), and any other columns but those of FIELDS."""
    config = config or LabelConfig()
    df = resolve_core(_shaped(tokens), "_texts", "_base", config)
    df = resolve_core(_second_try(df), "_again", "_rescued", config)
    df = override(df, "_result")
    return df.select(*[F.col(f"`{c}`") for c in tokens.columns], *[F.col(f"_result.{f}").alias(f) for f in FIELDS])
