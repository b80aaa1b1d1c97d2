"""String functions of labels, as columns. Patterns are Unicode-aware, as (?U) makes them."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

U = "(?U)"


def let(value: Column, use) -> Column:
    """use(value), the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def any_of(text: Column, words: list[str]) -> Column:
    """Whether text holds one of the words."""
    return text.rlike("|".join(words))


def shape(text: Column) -> Column:
    """Misread date shapes put right; then month and year without a day, which turn the text to upper case if they occur."""
    for pattern, to in fixed.SHAPES:
        text = F.regexp_replace(text, U + pattern, to)
    named = F.upper(text)
    for name, month in fixed.MONTH_BASE.items():
        named = F.regexp_replace(named, U + fixed.MONTH_YEAR.format(name), f"$2.{month:02d}")
    return F.when(F.upper(text).rlike(U + fixed.MONTH_YEAR.format("|".join(fixed.MONTH_BASE))), named).otherwise(text)


@cache
def _compatible() -> tuple[str, str]:
    """Characters that NFKC turns into one other, and those."""
    pairs = [(chr(c), n) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def nfkc_native(text: Column) -> Column:
    """NFKC for characters that become one other (full-width forms and the like); others stay as they are."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, *_compatible())).otherwise(text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_arrow(texts: pd.Series) -> pd.Series:
    """NFKC of all strings of an array, in Arrow batches."""
    return texts.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in xs])


def colon_date(text: Column) -> Column:
    """Upper case; a date in three parts with colons is no clock time and gets dots."""
    return F.regexp_replace(F.upper(text), U + fixed.COLON_DATE, "$1.$2.$3")


def strip_noise(text: Column) -> Column:
    for pattern, _ in fixed.NOISE:
        text = F.regexp_replace(text, U + pattern, " ")
    return text


def noise(text: Column) -> Column:
    """What strip_noise takes out: array of text and label."""
    out = []
    labelled = lambda label: lambda x: F.struct(x.alias("text"), F.lit(label).alias("label"))
    for pattern, label in fixed.NOISE:
        out.append(F.transform(F.regexp_extract_all(text, F.lit(f"{U}({pattern})"), 1), labelled(label)))
        text = F.regexp_replace(text, U + pattern, " ")
    return F.concat(*out)


def fold_separators(text: Column) -> Column:
    return F.translate(text, "".join(fixed.SEPARATORS), "".join(fixed.SEPARATORS.values()))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, U + r"\A\s+|\s+\z", "")


def cell(value: Column, width: int) -> Column:
    """A number with zeros in front, NONE for null."""
    return F.when(value.isNull(), "NONE").otherwise(F.format_string(f"%0{width}d", value))


def clean_cell(value: Column) -> Column:
    """The output form of a cell: trimmed, and NONE for every spelling of missing."""
    v = F.coalesce(strip(value.cast("string")), F.lit("NONE"))
    return F.when(F.upper(v).isin(*fixed.MISSING), "NONE").otherwise(v)


def final_date(year: Column, month: Column, day: Column) -> Column:
    """Cells joined by -, NONE alone if all are."""
    none = (year == "NONE") & (month == "NONE") & (day == "NONE")
    return F.when(none, "NONE").otherwise(F.concat_ws("-", year, month, day))


def zero_fill(value: Column, width: int = 6) -> Column:
    """Zeros in front up to width; longer values stay whole."""
    return F.when(F.length(value) < width, F.lpad(value, width, "0")).otherwise(value)


def date_shaped(text: Column) -> Column:
    return text.rlike(U + fixed.DATE_SHAPED)


def has_digit(text: Column) -> Column:
    return text.rlike(U + r"\d")
