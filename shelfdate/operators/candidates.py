"""Date candidates of an image's tokens, all within its row: no shuffle is needed."""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.dates import LabelConfig, cells, read_triple, valid_cells, year
from ..functions.text import U, any_of, colon_date, fold_separators, let, nfkc_arrow, nfkc_native, noise, strip, strip_noise

MONTHS = fixed.month_spellings()
_NAME = r"(?<![A-Z])(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")(?![A-Z])"
_NAMED = U + r"(?s)\A(.*?)" + _NAME + r"(.*)\z"
CANDIDATE = "array<struct<score:int,why:array<string>,y:int,m:int,d:int,fb:boolean,src:string>>"
_RAW = "array<struct<a:int,b:int,c:int,ctx:string,cut:boolean,fb:boolean,src:string>>"


def held(**columns: Column) -> Column:
    """These columns, worked out once however often they are used later (a generator is not merged into later projections)."""
    return F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, worked out once."""
    return df.select("*", held(**columns))


_BUILT: dict = {}


def steps(make):
    """Turns a generator of held columns and names to drop (tuples) into a function of a DataFrame. What it yields depends on its arguments alone and is built once for each of them: columns are many small calls to the JVM."""

    @wraps(make)
    def run(df: DataFrame, *args) -> DataFrame:
        key = (make, args, id(SparkContext._gateway))
        if key not in _BUILT:
            _BUILT[key] = list(make(*args))
        for step in _BUILT[key]:
            df = df.drop(*step) if isinstance(step, tuple) else df.select("*", step)
        return df

    return run


#: Columns that the steps of one pass leave behind.
LEFT = ("_nfkc", "_norm", "_clean", "_all", "_dropped", "_named", "_dated", "_months", "_tokens", "_raws", "_bare", "_digits", "_joins", "_read", "_exp_any", "_one", "_every", "_cands", "_some", "_voted", "_ranked")


def month_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])


def _ints(text: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(U + pattern), group), lambda x: x.try_cast("int"))


def _raw(a, b, c, ctx, cut, fb, src) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"), ctx.alias("ctx"), F.lit(cut).alias("cut") if isinstance(cut, bool) else cut.alias("cut"), F.lit(fb).alias("fb"), src.alias("src"))


def picked_year(numbers: Column, config: LabelConfig) -> Column:
    """The first valid four-digit year, else the first two-digit one within the window."""
    return F.coalesce(F.get(F.filter(numbers, lambda n: n.between(*config.years)), F.lit(0)), F.get(F.filter(numbers, lambda n: n.between(*config.window)), F.lit(0)) + 2000)


def beside_month(left: Column, right: Column, month: Column, config: LabelConfig) -> Column:
    """Dates from the numbers around a month's name: the last on the left is the day, or the first of two or more on the right; two cells at least."""

    def both(numbers: Column) -> Column:
        l, r = numbers["l"], numbers["r"]  # noqa: E741
        last = F.get(l, F.size(l) - 1)
        before = F.when(last.between(1, 31), valid_cells(F.coalesce(picked_year(r, config), picked_year(F.slice(l, 1, F.greatest(F.size(l) - 1, F.lit(0))), config)), month, last))
        first = F.get(r, F.lit(0))
        behind = F.when((F.size(r) >= 2) & first.between(1, 31), valid_cells(picked_year(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), config), month, first))
        return F.filter(F.array(before, behind), lambda x: x.isNotNull() & (cells(x) >= 2))

    numbers = lambda t: _ints(t, r"(\d{1,4})")
    return let(F.struct(numbers(left).alias("l"), numbers(right).alias("r")), both)


@steps
def month_candidates(config: LabelConfig):
    """_months: candidates from month names, token by token, and last the first month that got none. Wants _clean: tokens without noise."""
    # every name has a letter; what stands beside it is only looked for where there is one
    token = lambda tk, i: F.struct(F.when(tk.rlike("[A-Z]"), F.regexp_extract(tk, U + _NAME, 1)).otherwise("").alias("name"), tk.alias("tk"), i.alias("i"))
    beside = lambda x: F.struct(x["name"].alias("name"), F.regexp_extract(x["tk"], _NAMED, 1).alias("left"), F.regexp_extract(x["tk"], _NAMED, 3).alias("right"), F.coalesce(F.get("_clean", x["i"] - 1), F.lit("")).alias("prev"), F.coalesce(F.get("_clean", x["i"] + 1), F.lit("")).alias("next"), x["tk"].alias("tk"))
    yield held(_named=F.transform(F.filter(F.transform("_clean", token), lambda x: x["name"] != ""), beside))

    def dated(x: Column) -> Column:
        month = F.element_at(month_map(), x["name"])
        own = beside_month(x["left"], x["right"], month, config)
        wide = beside_month(F.concat_ws(" ", x["prev"], x["left"]), F.concat_ws(" ", x["right"], x["next"]), month, config)
        around = F.concat_ws(" ", x["prev"], x["tk"], x["next"])
        base = F.when(x["name"].isin(*fixed.MONTH_BASE, *fixed.MONTH_LONG), fixed.MONTH_NAME).otherwise(fixed.MONTH_MISREAD)
        return let(own, lambda o: F.struct(x["name"].alias("name"), month.alias("month"), F.when(F.size(o) > 0, o).otherwise(wide).alias("dates"), (base + F.when(F.size(o) > 0, 0).otherwise(-fixed.NEIGHBOUR) + fixed.MONTH_BONUS).alias("score"), any_of(around, fixed.EXPIRY_WORDS).alias("exp"), any_of(around, fixed.MADE_WORDS).alias("made")))

    yield held(_dated=F.transform("_named", dated))
    said = lambda x: F.concat(F.lit("월이름 '"), x["name"], F.lit("'→"), x["month"].cast("string"), F.lit("월"))
    why = lambda x: F.concat(F.array(said(x)), F.when(x["exp"], F.array(F.lit(fixed.WHY["expiry"]))).otherwise(F.array().cast("array<string>")), F.when(x["made"], F.array(F.lit(fixed.WHY["made"]))).otherwise(F.array().cast("array<string>")))
    score = lambda x: x["score"] + F.when(x["exp"], fixed.EXPIRY).otherwise(0) - F.when(x["made"], fixed.MADE).otherwise(0)
    no_src = F.lit(None).cast("string")
    found = F.flatten(F.transform("_dated", lambda x: F.transform(x["dates"], lambda p: F.struct(score(x).alias("score"), why(x).alias("why"), p["y"].alias("y"), p["m"].alias("m"), p["d"].alias("d"), F.lit(False).alias("fb"), no_src.alias("src")))))
    alone = F.transform(F.slice(F.filter("_dated", lambda x: F.size(x["dates"]) == 0), 1, 1), lambda x: F.struct(F.lit(fixed.MONTH_ALONE).alias("score"), F.array(F.concat(said(x), F.lit(" (월만 판독)"))).alias("why"), F.lit(None).cast("int").alias("y"), x["month"].alias("m"), F.lit(None).cast("int").alias("d"), F.lit(False).alias("fb"), no_src.alias("src")))
    yield held(_months=F.when(F.size("_named") > 0, F.concat(found.cast(CANDIDATE), alone.cast(CANDIDATE))).otherwise(F.array().cast(CANDIDATE)))


def _trimmed(sa: Column, sb: Column, sc: Column, ctx: Column, src: Column) -> Column:
    """A triple as read, and with a first or last field cut down that has too many digits."""
    num = lambda x: x.try_cast("int")
    n = F.length(sc)
    return F.filter(
        F.array(
            _raw(num(sa), num(sb), num(sc), ctx, False, False, src),
            F.when((n == 3) | ((n == 4) & ~F.substring(sc, 1, 1).isin("1", "2")), _raw(num(sa), num(sb), num(F.substring(sc, 1, 2)), ctx, True, False, src)),
            F.when(n >= 5, _raw(num(sa), num(sb), num(F.substring(sc, 1, 4)), ctx, True, False, src)),
            F.when(n >= 5, _raw(num(sa), num(sb), num(F.substring(sc, 1, 2)), ctx, True, False, src)),
            F.when(F.length(sa).isin(3, 5), _raw(num(F.substring(sa, 2, 5)), num(sb), num(sc), ctx, True, False, src)),
        ),
        lambda x: x.isNotNull(),
    )


@steps
def number_triples(config: LabelConfig):
    """_raws: number triples of every token in order. Runs of 8 digits and separated triples always count; the other shapes each only if none before it was found in the token. Wants _clean and _srcs."""
    all_ = lambda t, p, g: F.regexp_extract_all(t, F.lit(U + p), g)
    token = lambda tk, i: let(fold_separators(tk), lambda t: F.struct(tk.alias("ctx"), t.alias("it"), F.get("_srcs", i).alias("src"), all_(t, fixed.RUN_8, 1).alias("r8"), all_(t, fixed.TRIPLE, 1).alias("ta"), all_(t, fixed.TRIPLE, 2).alias("tb"), all_(t, fixed.TRIPLE, 3).alias("tc")))
    yield held(_tokens=F.filter(F.transform("_clean", token), lambda x: x["it"].rlike(U + r"\d")))
    num = lambda x: x.try_cast("int")
    none = F.array().cast(_RAW)

    def rest(x: Column) -> Column:
        t, ctx, src = x["it"], x["ctx"], x["src"]
        zipped = lambda p, *g: F.arrays_zip(*[all_(t, p, k).alias(f"g{k}") for k in g])
        joined = F.filter(F.transform(zipped(fixed.YEAR_MONTH_RUN_DAY, 1, 2, 3), lambda z: _raw(num(z["g1"]), num(z["g2"]), num(z["g3"]), ctx, False, False, src)), lambda r: r["a"].between(*config.years))
        month = F.transform(zipped(fixed.YEAR_MONTH, 1, 2), lambda z: _raw(num(z["g1"]), num(z["g2"]), F.lit(0), ctx, False, False, src))
        six = F.transform(all_(t, fixed.RUN_6, 1), lambda s: _raw(num(F.substring(s, 1, 2)), num(F.substring(s, 3, 2)), num(F.substring(s, 5, 2)), ctx, False, True, src))
        day = F.transform(zipped(fixed.MONTH_DAY, 1, 2), lambda z: _raw(F.lit(0), num(z["g1"]), num(z["g2"]), ctx, False, False, src))
        either = lambda found, other: let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(other))
        return either(joined, either(month, either(six, day)))

    def triples(x: Column) -> Column:
        ctx, src = x["ctx"], x["src"]
        eight = F.flatten(F.transform(x["r8"], lambda s: F.array(_raw(num(F.substring(s, 1, 4)), num(F.substring(s, 5, 2)), num(F.substring(s, 7, 2)), ctx, F.length(s) > 8, False, src), _raw(num(F.substring(s, 1, 2)), num(F.substring(s, 3, 2)), num(F.substring(s, 5, 4)), ctx, F.length(s) > 8, False, src))))
        three = F.flatten(F.transform(F.arrays_zip(x["ta"].alias("ta"), x["tb"].alias("tb"), x["tc"].alias("tc")), lambda z: _trimmed(z["ta"], z["tb"], z["tc"], ctx, src)))
        return F.when(F.size(x["r8"]) + F.size(x["ta"]) > 0, F.concat(eight.cast(_RAW), three.cast(_RAW))).otherwise(rest(x).cast(_RAW))

    yield held(_raws=F.when(F.size("_tokens") > 0, F.flatten(F.transform("_tokens", triples))).otherwise(none))


@steps
def joined_triples():
    """_joins: three neighbours within a run of tokens that are 1 to 4 digits each; context is the token before the run. Wants _norm."""
    yield held(_bare=F.transform("_norm", strip))
    yield held(_digits=F.transform("_bare", lambda t: t.rlike(U + r"\A\d{1,4}\z")))
    at = lambda i, k: F.get("_bare", i + k)
    starts = F.filter(F.sequence(F.lit(0), F.size("_bare") - 3), lambda i: F.get("_digits", i) & F.get("_digits", i + 1) & F.get("_digits", i + 2))
    before = lambda i: F.array_max(F.filter(F.sequence(F.lit(0), i), lambda j: ~F.get("_digits", j)))
    four = lambda i: (F.length(at(i, 0)) == 4) | (F.length(at(i, 1)) == 4) | (F.length(at(i, 2)) == 4)
    kind = "array<struct<a:int,b:int,c:int,ctx:string,bonus:int>>"
    found = F.transform(starts, lambda i: F.struct(at(i, 0).try_cast("int").alias("a"), at(i, 1).try_cast("int").alias("b"), at(i, 2).try_cast("int").alias("c"), F.coalesce(F.get("_bare", before(i)), F.lit("")).alias("ctx"), F.when(four(i), fixed.JOINED_YEAR).otherwise(0).alias("bonus")))
    some = (F.size("_bare") >= 3) & (F.size(F.filter("_digits", lambda x: x)) >= 3)
    yield held(_joins=F.when(some, found.cast(kind)).otherwise(F.array().cast(kind)))


@steps
def scored(config: LabelConfig):
    """_cands: all candidates in order, scored; fallback ones only where there is no other. Wants _months, _raws, _joins and _all, the tokens joined and without noise."""
    reason = lambda on, name: F.when(on, F.array(F.lit(fixed.WHY[name]))).otherwise(F.array().cast("array<string>"))
    one = F.size(F.array_distinct(F.transform("_raws", lambda r: r["ctx"]))) == 1

    def read(r: Column) -> Column:
        return let(read_triple(r["a"], r["b"], r["c"], config), lambda s: F.when(s.isNotNull(), F.struct(valid_cells(s["y"], s["m"], s["d"]).alias("v"), s["rule"].alias("rule"), r.alias("r"))))

    yield held(_read=F.filter(F.transform("_raws", read), lambda x: x.isNotNull() & (cells(x["v"]) > 0)), _exp_any=F.when(F.size("_raws") > 0, any_of(F.col("_all"), fixed.EXPIRY_WORDS)).otherwise(F.lit(False)), _one=one)

    def weigh(x: Column) -> Column:
        r, v = x["r"], x["v"]

        def told(k: Column) -> Column:
            near = k["exp"] | (F.col("_one") & ~k["made"] & F.col("_exp_any"))
            points = F.element_at(F.create_map(*[F.lit(i) for p in fixed.CELL_SCORE.items() for i in p]), cells(v))
            score = points + F.when(near, fixed.EXPIRY).otherwise(0) - F.when(k["made"], fixed.MADE).otherwise(0) - F.when(r["cut"], fixed.CUT).otherwise(0) - F.when(r["fb"], fixed.FALLBACK).otherwise(0)
            why = F.concat(F.array(x["rule"]), reason(near, "expiry"), reason(k["made"], "made"), reason(r["cut"], "cut"), reason(r["fb"], "fallback"))
            return F.struct(score.alias("score"), why.alias("why"), v["y"].alias("y"), v["m"].alias("m"), v["d"].alias("d"), r["fb"].alias("fb"), r["src"].alias("src"))

        return let(F.struct(any_of(r["ctx"], fixed.EXPIRY_WORDS).alias("exp"), any_of(r["ctx"], fixed.MADE_WORDS).alias("made")), told)

    def weigh_joined(x: Column) -> Column:
        r, v = x["r"], x["v"]
        exp, made = any_of(r["ctx"], fixed.EXPIRY_WORDS), any_of(r["ctx"], fixed.MADE_WORDS)
        score = fixed.JOINED + r["bonus"] + F.when(exp, fixed.EXPIRY).otherwise(0) - F.when(made, fixed.MADE).otherwise(0)
        why = F.concat(F.array(x["rule"], F.lit(fixed.WHY["joined"])), reason(exp, "expiry"), reason(made, "made"))
        return F.struct(score.alias("score"), why.alias("why"), v["y"].alias("y"), v["m"].alias("m"), v["d"].alias("d"), F.lit(False).alias("fb"), F.lit("join").alias("src"))

    joins = F.filter(F.transform("_joins", read), lambda x: x.isNotNull() & (cells(x["v"]) == 3))
    everything = F.concat(F.col("_months"), F.transform("_read", weigh).cast(CANDIDATE), F.transform(joins, weigh_joined).cast(CANDIDATE))
    yield held(_every=everything)
    sure = F.filter("_every", lambda c: ~c["fb"])
    yield held(_cands=let(sure, lambda s: F.when(F.size(s) > 0, s).otherwise(F.col("_every"))))


@steps
def clean_tokens(texts: str, config: LabelConfig):
    """_norm: tokens in normal form; _clean: without noise; _all: joined, without noise; _dropped: the noise."""
    if config.nfkc == "arrow":
        yield nfkc_arrow(F.col(texts)).alias("_nfkc")
        yield held(_norm=F.transform("_nfkc", colon_date))
    else:
        yield held(_norm=F.transform(texts, lambda t: colon_date(nfkc_native(t))))
    joined = F.array_join("_norm", " ")
    digits = joined.rlike(U + r"\d")  # all noise has some
    yield held(_clean=F.transform("_norm", lambda t: F.when(t.rlike(U + r"\d"), strip_noise(t)).otherwise(t)), _all=F.when(digits, strip_noise(joined)).otherwise(joined), _dropped=F.when(digits, noise(joined)).otherwise(F.array().cast("array<struct<text:string,label:string>>")))
