"""Override rules that follow the ranking, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import U, final_date, let
from .candidates import held, steps

I = U + "(?i)"  # noqa: E741


def rescue_shapes(token: Column) -> Column:
    """A token rewritten for the second try: repeated year, trailing serial, joined month and day, spaces, attached month name, best-before mark."""
    whole = lambda t, p, unless=None: F.when(t.rlike(U + p) & (~t.rlike(U + unless) if unless else F.lit(True)), F.concat_ws(".", *[F.regexp_extract(t, U + p, k) for k in (1, 2, 3)])).otherwise(t)
    t = F.regexp_replace(token, U + fixed.REPEATED_YEAR, "$1.$2.$3")
    t = whole(t, fixed.TRAILING_SERIAL)
    t = whole(t, fixed.JOINED_MONTH_DAY)
    t = whole(t, fixed.SPACED, fixed.SPACED_UNLESS)
    t = let(t, attached_month)
    return F.regexp_replace(t, I + fixed.BEST_BEFORE_COLON, "$1 ")


def attached_month(t: Column) -> Column:
    """A month's name with its day and year attached, if they are plausible: no day 20 to 25 before a two-digit year."""
    pattern = I + fixed.ATTACHED_MONTH.format("|".join(fixed.RESCUE_MONTHS))
    month = F.element_at(F.create_map(*[F.lit(x) for p in fixed.RESCUE_MONTHS.items() for x in p]), F.upper(F.regexp_extract(t, pattern, 1)))
    dd, yy = F.regexp_extract(t, pattern, 2), F.regexp_extract(t, pattern, 3)
    day, short = dd.try_cast("int"), yy.try_cast("int")
    year = F.when(short < 100, short + 2000).otherwise(short)
    good = t.rlike(pattern) & day.between(1, 31) & year.between(*fixed.RESCUE_YEARS) & ~(dd.isin("20", "21", "22", "23", "24", "25") & (F.length(yy) == 2))
    return F.when(good, F.format_string("%04d.%02d.%02d", year, month, day)).otherwise(t)


def _with(res: Column, on: Column, year: Column, month: Column, day: Column, why: str) -> Column:
    """res with another date and the reason added, where on."""
    new = res.withField("year", year).withField("month", month).withField("day", day).withField("final_date", F.concat_ws("-", year, month, day)).withField("rule", F.concat(res["rule"], F.lit(f" + {fixed.WHY[why]}")))
    return F.when(on, new).otherwise(res)


@steps
def override(name: str):
    """name: the result after all override rules. Wants _base and _rescued (results) and _joined (shaped tokens joined)."""
    base, rescued, joined = F.col("_base"), F.col("_rescued"), F.col("_joined")
    yield held(_eu=joined.rlike(I + fixed.EU_WORDS), _kr=joined.rlike(I + fixed.KR_WORDS))
    none = base["final_date"] == "NONE"
    saved = rescued.withField("rule", F.concat(rescued["rule"], F.lit(f" + {fixed.WHY['rescued']}")))
    # day and month change places on goods with a barcode or words of the Americas
    swappable = ~none & base["rule"].contains("DD.MM.YY") & ~F.col("_eu")
    code = F.exists(F.regexp_extract_all(joined, F.lit(U + fixed.BARCODE), 1), lambda b: F.substring(F.lpad(b, 13, "0"), 1, 3).try_cast("int") <= fixed.US_PREFIX)
    us = swappable & base["day"].try_cast("int").between(1, 12) & (code | joined.rlike(I + fixed.US_WORDS))
    yield held(_r=F.when(none & (rescued["final_date"] != "NONE"), saved).otherwise(_with(base, us, base["year"], base["day"], base["month"], "us")))
    # two-digit years behind, on European goods
    r = F.col("_r")
    zipped = F.arrays_zip(*[F.regexp_extract_all(joined, F.lit(U + fixed.EU_DATE), k).alias(f"g{k}") for k in (1, 2, 3)])
    wanted = lambda z: (r["final_date"] != F.concat_ws("-", F.concat(F.lit("20"), z["g3"]), z["g2"], z["g1"])) & ((r["final_date"] == "NONE") | r["final_date"].startswith(F.concat(F.lit("20"), z["g1"])) | r["final_date"].startswith("2030"))
    yield held(_e=F.when(F.col("_eu") & ~F.col("_kr"), F.get(F.filter(zipped, wanted), F.lit(0))))
    e = F.col("_e")
    yield held(_r4=_with(r, e.isNotNull(), F.concat(F.lit("20"), e["g3"]), e["g2"], e["g1"], "eu"))
    # an expiry date beside a production date
    r, part = F.col("_r4"), lambda k: F.regexp_extract(joined, I + fixed.EXP_DATE, k).try_cast("int")
    y = F.when(F.length(F.regexp_extract(joined, I + fixed.EXP_DATE, 3)) == 2, part(3) + 2000).otherwise(part(3))
    yield held(_x=F.when(joined.rlike(I + fixed.EXP_DATE) & F.upper(joined).rlike("PROD|PRCR"), F.struct(F.format_string("%04d", y).alias("y"), F.format_string("%02d", part(2)).alias("m"), F.format_string("%02d", part(1)).alias("d"))))
    x = F.col("_x")
    cand = F.concat_ws("-", x["y"], x["m"], x["d"])
    later = x.isNotNull() & (r["final_date"] != cand) & ((r["final_date"] == "NONE") | (r["final_date"] < cand))
    yield held(_r5=_with(r, later, x["y"], x["m"], x["d"], "exp"))
    # dot-matrix misreadings, of what is still open; later ones replace earlier ones
    r = F.col("_r5")
    open_ = r["final_date"] == "NONE"
    got = lambda p, k: F.regexp_extract(joined, U + p, k)
    for pattern, why in ((fixed.DOT_6, "dot"), (fixed.DOT_W, "w")):
        r = _with(r, open_ & joined.rlike(U + pattern), got(pattern, 1), F.concat(F.lit("0"), got(pattern, 2)), got(pattern, 3), why)
        yield held(**{f"_r6{why}": r, f"_o{why}": open_})
        r, open_ = F.col(f"_r6{why}"), F.col(f"_o{why}")
    r = _with(r, open_ & joined.rlike(U + fixed.DOT_9EP), got(fixed.DOT_9EP, 2), F.lit("09"), F.format_string("%02d", got(fixed.DOT_9EP, 1).try_cast("int")), "9ep")
    yield held(_r7=r)
    r = F.col("_r7")
    yield r.withField("final_date", final_date(r["year"], r["month"], r["day"])).alias(name)
