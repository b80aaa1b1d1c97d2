"""Votes, ranking and the result of the best candidate, within an image's row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.dates import LabelConfig, cells
from ..functions.text import cell, let
from .candidates import LEFT, held, steps

RESULT = "struct<year:string,month:string,day:string,final_date:string,rule:string,score:double,margin:int,dropped:array<struct<text:string,label:string>>,alts:array<string>,votes:int,all_cands:array<struct<y:int,m:int,d:int>>>"


def date_key(c: Column) -> Column:
    """Sortable number of a date, missing cells as 0."""
    zero = lambda v: F.coalesce(v, F.lit(0))
    return zero(c["y"]) * 10000 + zero(c["m"]) * 100 + zero(c["d"])


@steps
def voted(config: LabelConfig):
    """_cands with votes: how many reading paths gave the same cells, nulls alike. Two or more are told in why and may earn a bonus."""
    bonus = dict(config.votes)
    some = F.exists("_cands", lambda c: c["src"].isNotNull())
    same = lambda c, o: o["src"].isNotNull() & o["y"].eqNullSafe(c["y"]) & o["m"].eqNullSafe(c["m"]) & o["d"].eqNullSafe(c["d"])

    def count(c: Column) -> Column:
        n = F.when(F.col("_some"), F.size(F.array_distinct(F.transform(F.filter("_cands", lambda o: same(c, o)), lambda o: o["src"])))).otherwise(0)
        return let(n, lambda k: F.struct((c["score"] + _bonus(k, bonus)).alias("score"), F.when(k >= 2, F.concat(c["why"], F.array(F.concat(k.cast("string"), F.lit("개 경로 일치"))))).otherwise(c["why"]).alias("why"), c["y"].alias("y"), c["m"].alias("m"), c["d"].alias("d"), k.alias("votes")))

    yield held(_some=some)
    yield held(_voted=F.transform("_cands", count))


def _bonus(votes: Column, bonus: dict[int, int]) -> Column:
    out = F.lit(0)
    for n, points in bonus.items():
        if n >= 2 and points:
            out = F.when(votes == n, points).otherwise(out)
    return out


@steps
def ranked():
    """_ranked: candidates by score, cells and date, each falling, then in the order they were found."""
    keyed = F.transform("_voted", lambda c, i: F.struct((-c["score"]).alias("k1"), (-cells(c)).alias("k2"), (-date_key(c)).alias("k3"), i.alias("k4"), c.alias("c")))
    yield held(_ranked=F.transform(F.array_sort(keyed), lambda x: x["c"]))


def confidence(margin: Column) -> Column:
    """0.45 and 1/120 a point, 0.99 at most, to two places; half cents round as their binary value does."""
    halves = {m: round(0.45 + m / 120, 2) for m in range(-201, 65) if m % 6 == 3}
    out = F.element_at(F.create_map(*[F.lit(x) for pair in halves.items() for x in pair]), margin)
    return F.coalesce(out, F.round(F.least(F.lit(0.99), 0.45 + margin / 120), 2))


@steps
def best(name: str):
    """Column name: the result of the first ranked candidate. Wants _ranked and _dropped."""
    top, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))

    def told(c: Column) -> Column:
        margin = F.when(second.isNotNull(), c["score"] - second["score"]).otherwise(c["score"])
        y, m, d = cell(c["y"], 4), cell(c["m"], 2), cell(c["d"], 2)
        whole = cells(c) == 3
        alts = F.transform(F.slice("_ranked", 2, 3), lambda x: F.concat(cell(x["y"], 4), F.lit("-"), cell(x["m"], 2), F.lit("-"), cell(x["d"], 2), F.lit("("), x["score"].cast("string"), F.lit(")")))
        return F.struct(y, m, d, F.when(whole, F.concat_ws("-", y, m, d)).otherwise("NONE"), F.array_join(c["why"], " + "), confidence(margin), margin, F.col("_dropped"), alts, c["votes"], F.transform("_ranked", lambda x: F.struct(x["y"], x["m"], x["d"]))).cast(RESULT)

    none = F.lit("NONE")
    empty = F.struct(none, none, none, none, F.lit(fixed.WHY["none"]), F.lit(0.0), F.lit(0), F.col("_dropped"), F.array().cast("array<string>"), F.lit(None).cast("int"), F.array().cast("array<struct<y:int,m:int,d:int>>")).cast(RESULT)
    yield held(**{name: F.when(F.size("_ranked") > 0, let(top, told)).otherwise(empty)})
    yield LEFT
