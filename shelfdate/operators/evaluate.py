"""Scores of runs against labels, and of runs against one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import zero_fill

CELLS = ("year", "month", "day")


def _same(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in CELLS]


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def against_labels(run: DataFrame, gold: DataFrame) -> DataFrame:
    """p and g, prediction and label of the images that have both: by the zero-filled id, else by the id as it is."""
    p = run.select(F.struct(*run.columns).alias("p"), zero_fill(F.col("image_id")).alias("_k"), F.col("image_id").alias("_id"))
    g = gold.select(F.struct(*gold.columns).alias("g"), F.col("image_id").alias("_k"))
    padded = p.join(g, "_k", "left")
    raw = padded.where("g is null and _id <> _k").drop("g", "_k").join(g.withColumnRenamed("_k", "_id"), "_id")
    return padded.where("g is not null").select("p", "g").union(raw.select("p", "g"))


def score_parts(run: DataFrame, gold: DataFrame) -> DataFrame:
    """sec, and of the images that took it: how many, whole matches, matching cells, false positives and misses. Parts of several runs add up to those of all."""
    same = _same("p", "g")
    none = lambda x: _all([F.col(f"{x}.{c}") == "NONE" for c in CELLS])
    whole = _all([F.col(f"p.{c}") != "NONE" for c in CELLS])
    return against_labels(run, gold).groupBy(F.col("p.sec").alias("sec")).agg(
        F.count("*").alias("n"),
        F.count_if(_all(same)).alias("full"),
        F.sum(sum(s.cast("int") for s in same)).alias("cells"),
        F.count_if((F.col("g.final_date") == "NONE") & whole).alias("false_positive"),
        F.count_if(none("p") & ~none("g")).alias("miss_all_none"),
    )


def score(run: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: matches, false positives, misses and times. The median is the upper one; a summary of nothing has n 0."""
    return score_of(score_parts(run, gold))


def score_of(parts: DataFrame) -> DataFrame:
    """The score of parts. Seconds are told to hundredths, so that parts have few rows whatever the number of images."""
    added = parts.groupBy("sec").agg(*[F.sum(c).alias(c) for c in ("n", "full", "cells", "false_positive", "miss_all_none")])
    sums = added.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("full", "cells", "false_positive", "miss_all_none")],
        (F.sum(F.col("sec") * F.col("n")) / F.sum(F.when(F.col("sec").isNotNull(), F.col("n")))).alias("mean"),
        F.max("sec").alias("sec_max"),
        F.sort_array(F.collect_list(F.when(F.col("sec").isNotNull(), F.struct("sec", "n")))).alias("times"),
    )
    # the first time that more than half of the images don't exceed
    before = F.aggregate("times", F.struct(F.lit(0).cast("long").alias("k"), F.lit(None).cast("double").alias("m")), lambda a, t: F.struct((a["k"] + t["n"]).alias("k"), F.coalesce(a["m"], F.when(a["k"] + t["n"] > F.floor(F.aggregate("times", F.lit(0).cast("long"), lambda s, u: s + u["n"]) / 2), t["sec"])).alias("m")))["m"]
    n = F.greatest("n", F.lit(1))
    mean = F.round(F.coalesce("mean", F.lit(0.0)), 2)
    return sums.select("n", "full", F.round(100 * F.col("full") / n, 2).alias("full_pct"), F.round(100 * F.col("cells") / (3 * n), 2).alias("cells_pct"), "false_positive", "miss_all_none", mean.alias("sec_mean"), before.alias("sec_median"), "sec_max", F.round(mean * 500 / 4 / 60, 1).alias("min_4core_500"))


def report(runs: DataFrame) -> DataFrame:
    """Lines of the table of runs, best first. runs: the columns of score and name."""
    line = F.format_string("%-28s n=%d full=%d (%.2f%%) cells=%.2f%% FP=%d miss=%d %.2fs/img median %.2f max %.2f 4c500=%.1fmin", "name", "n", "full", "full_pct", "cells_pct", "false_positive", "miss_all_none", "sec_mean", F.coalesce("sec_median", F.lit(0.0)), F.coalesce("sec_max", F.lit(0.0)), "min_4core_500")
    return runs.orderBy(F.desc("full"), "name").select(line.alias("line"))


def stage_histogram(run: DataFrame) -> DataFrame:
    """Images, share and errors (stages under 0) by stage."""
    counts = run.groupBy("stage").agg(F.count("*").alias("images"))
    total = run.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("stage", "images", F.round(100 * F.col("images") / F.col("total"), 1).alias("share_pct"), F.when(F.col("stage") < 0, F.col("images")).otherwise(0).alias("errors")).orderBy("stage")


def stage_map(run: DataFrame) -> DataFrame:
    """stages: one map of stage to images, as summaries hold it."""
    named = F.when(F.col("stage") == F.floor("stage"), F.col("stage").cast("long").cast("string")).otherwise(F.col("stage").cast("string"))
    return run.groupBy(named.alias("k")).agg(F.count("*").alias("v")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("stages"))


def changes(run: DataFrame, base: DataFrame, gold: DataFrame) -> DataFrame:
    """image_id and change (gain or lose) of the labelled images of both runs whose full match differs."""
    j = run.select("image_id", F.struct(*CELLS).alias("a")).join(base.select("image_id", F.struct(*CELLS).alias("b")), "image_id").join(gold.select("image_id", F.struct(*CELLS, "final_date").alias("g")), "image_id")
    a, b = _all(_same("a", "g")), _all(_same("b", "g"))
    return j.where(a != b).select("image_id", F.when(a, "gain").otherwise("lose").alias("change"), F.col("g.final_date").alias("gold"), F.concat_ws("-", *[f"b.{c}" for c in CELLS]).alias("base"), F.concat_ws("-", *[f"a.{c}" for c in CELLS]).alias("new"))


def gain_loss(run: DataFrame, base: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: gains and losses of a run against a base run."""
    return changes(run, base, gold).agg(F.count_if(F.col("change") == "gain").alias("gain"), F.count_if(F.col("change") == "lose").alias("lose"))


def todo(images: DataFrame, log: DataFrame) -> DataFrame:
    """The images that a run log doesn't hold yet; failed ones count as done."""
    return images.join(log.select("image_id").distinct(), "image_id", "left_anti")


def self_check(rows: DataFrame, expected: int) -> DataFrame:
    """One row of the checks after a run: columns, rows, emptiness, the form of final_date, and ok for all."""
    form = (F.col("final_date") == "NONE") | (F.length("final_date") - F.length(F.replace("final_date", F.lit("-"))) == 2)
    columns = tuple(rows.columns) == fixed.PREDICTION
    checks = rows.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(form, F.lit(False))).alias("bad_form"))
    ok = F.lit(columns) & (F.col("rows") == expected) & (F.col("rows") > 0) & (F.col("bad_form") == 0)
    return checks.select(F.lit(columns).alias("header_ok"), "rows", (F.col("rows") == expected).alias("rows_ok"), (F.col("rows") > 0).alias("not_empty"), "bad_form", ok.alias("ok"))
