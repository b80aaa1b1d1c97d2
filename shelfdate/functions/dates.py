"""Interpretation and validity of number triples, as columns."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


@dataclass(frozen=True)
class LabelConfig:
    """as_of_year: the current year, an explicit input so that results can be repeated. yy_back, yy_fwd: how far a two-digit year may lie from it. votes: bonus by number of reading paths that agree. nfkc: arrow (all of it) or native (characters that become one other)."""

    as_of_year: int = field(default_factory=lambda: datetime.date.today().year)
    yy_back: int = 7
    yy_fwd: int = 1
    votes: tuple[tuple[int, int], ...] = ()
    nfkc: str = "arrow"

    @property
    def years(self) -> tuple[int, int]:
        return 2015, self.as_of_year + 8

    @property
    def window(self) -> tuple[int, int]:
        return (self.as_of_year - self.yy_back) % 100, (self.as_of_year + self.yy_fwd) % 100


def year(value: Column, config: LabelConfig) -> Column:
    """The year if it is within the valid years, else null."""
    return F.when(value.between(*config.years), value)


def read_triple(a: Column, b: Column, c: Column, config: LabelConfig) -> Column:
    """Year, month, day and rule of three numbers; there is one reading for each, or none (null)."""
    of = lambda y, m, d, rule: F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"), F.lit(fixed.RULES[rule]).alias("rule"))
    long_, short = lambda x: year(x, config), lambda x: year(x + 2000, config)
    late = b >= 13
    return (
        F.when(a == 0, of(F.lit(None), b, c, "no year"))
        .when(a >= 1000, F.when(late, of(long_(a), c, b, "YDM")).otherwise(of(long_(a), b, c, "YMD")))
        .when(c >= 1000, F.when(late, of(long_(c), a, b, "MDY")).otherwise(of(long_(c), b, a, "DMY")))
        .when(a.between(*config.window), F.when(late, of(short(a), c, b, "yDM")).otherwise(of(short(a), b, c, "yMD")))
        .when(c.between(*config.window), F.when(late, of(short(c), a, b, "MDy")).otherwise(of(short(c), b, a, "DMy")))
    )


def valid_cells(y: Column, m: Column, d: Column) -> Column:
    """y, m, d with only the impossible cells null; a day that its month doesn't have goes."""
    month, day = F.when(m.between(1, 12), m), F.when(d.between(1, 31), d)
    whole = y.isNotNull() & month.isNotNull() & day.isNotNull()
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    real = day <= F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.struct(y.cast("int").alias("y"), month.cast("int").alias("m"), F.when(~whole | real, day).cast("int").alias("d"))


def cells(x: Column) -> Column:
    return x["y"].isNotNull().cast("int") + x["m"].isNotNull().cast("int") + x["d"].isNotNull().cast("int")
