"""The queries of the driver contract, each over its whole tables, and the SQL for the same rows.

Labels are rendered from known date columns and resolved again; the SQL works the expected cells out from the dates alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.dates import LabelConfig
from ..functions.text import clean_cell, date_shaped, has_digit, noise, strip_noise, zero_fill
from ..operators import evaluate
from ..operators.boxes import crop_boxes, widest
from ..operators.candidates import hold, joined_triples
from .ladder import run_ladder
from .resolver import resolve_dates

#: All queries are as of this year; labels here are ASCII, for which native NFKC is all of it.
CONFIG = LabelConfig(as_of_year=2026, nfkc="native")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.to_date("ts").alias("d"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.add_months(F.to_date("o_orderdate"), 300).alias("d"), F.to_date("o_orderdate").alias("was"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.add_months(F.to_date("l_shipdate"), 300).alias("d"), "l_partkey", "l_suppkey", "l_quantity")


def _spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files are too few to be: resolving is worth more than moving a short label."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _fmt(pattern: str, of: str = "d") -> Column:
    return F.date_format(of, pattern)


def _resolve(df: DataFrame, *texts: Column, keys: tuple[str, ...] = ("id",), more: tuple[str, ...] = (), config: LabelConfig = CONFIG) -> DataFrame:
    """keys and the cells, date and margin of labels made of these tokens."""
    none = F.lit(None).cast("string")
    labels = _spread(df.select(*keys, F.array(*[F.struct(t.alias("text"), none.alias("src")) for t in texts]).alias("items")))
    return resolve_dates(labels, config).select(*keys, "year", "month", "day", "final_date", *more)


_EV = "(select event_id as id, cast(ts as date) as d from events)"
_OR = "(select o_orderkey as id, cast(cast(o_orderdate as date) + interval 25 year as date) as d, cast(o_orderdate as date) as was from orders)"
_LI = "(select l_orderkey as id, l_linenumber as line, cast(cast(l_shipdate as date) + interval 25 year as date) as d, l_partkey, l_suppkey, l_quantity from lineitem)"
_CELLS = "strftime(d, '%Y') as year, strftime(d, '%m') as month, strftime(d, '%d') as day, strftime(d, '%Y-%m-%d') as final_date"
_FINAL = "case when year = 'NONE' and month = 'NONE' and day = 'NONE' then 'NONE' else year || '-' || month || '-' || day end as final_date"


@query(f"select id, {_CELLS}, 20 as margin from {_EV}")
def parse_ymd_sep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year, month, day with three kinds of separators."""
    k = F.col("id") % 3
    return _resolve(_events(spark, sf_dir), F.when(k == 0, _fmt("yyyy.MM.dd")).when(k == 1, _fmt("yyyy-MM-dd")).otherwise(_fmt("yyyy / MM / dd")), more=("margin",))


@query(f"select id, {_CELLS}, 12 as margin from {_EV}")
def parse_compact8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight digits: two readings, of which the whole date wins by 20 to 8."""
    return _resolve(_events(spark, sf_dir), _fmt("yyyyMMdd"), more=("margin",))


@query(f"""select id, year, month, day, {_FINAL} from (select id, strftime(d, '%Y') as year,
 case when id % 2 = 1 and day(d) < 13 then strftime(d, '%d') else strftime(d, '%m') end as month,
 case when id % 2 = 1 and day(d) < 13 then strftime(d, '%m') else strftime(d, '%d') end as day from {_OR})""")
def parse_dmy_mdy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year behind: the day comes first, unless the second number can be no month."""
    return _resolve(_orders(spark, sf_dir), F.when(F.col("id") % 2 == 0, _fmt("dd/MM/yyyy")).otherwise(_fmt("MM/dd/yyyy")))


@query(f"""select id, year, month, day, {_FINAL} from (select id,
 case when id % 3 = 0 then strftime(d, '%Y') when day(d) between 19 and 27 then '20' || strftime(d, '%d') when id % 3 = 1 then strftime(d, '%Y') else 'NONE' end as year,
 case when id % 3 = 2 and day(d) not between 19 and 27 then 'NONE' else strftime(d, '%m') end as month,
 case when id % 3 = 0 then strftime(d, '%d') when id % 3 = 1 then case when day(d) between 19 and 27 then strftime(d, '%y') else strftime(d, '%d') end
  when day(d) not between 19 and 27 then 'NONE' when year(was) % 100 between 1 and 31 then strftime(was, '%y') else 'NONE' end as day from {_OR})""")
def parse_two_digit_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-digit years: in front, behind, and (of the unshifted dates) outside the window."""
    k = F.col("id") % 3
    old = F.concat(_fmt("dd.MM."), F.date_format("was", "yy"))
    return _resolve(_orders(spark, sf_dir), F.when(k == 0, _fmt("yy.MM.dd")).when(k == 1, _fmt("dd.MM.yy")).otherwise(old))


@query(f"select id, {_CELLS}, 170 as margin from {_OR}")
def parse_month_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month names between day and year, and in front of them."""
    return _resolve(_orders(spark, sf_dir), F.upper(F.when(F.col("id") % 2 == 0, _fmt("dd MMM yyyy")).otherwise(_fmt("MMM dd yyyy"))), more=("margin",))


#: One misreading of each month's name.
_MISREAD = ["IAN", "FE8", "M4R", "4PR", "MAV", "IUN", "JU1", "AU6", "5EP", "0CT", "N0V", "DE0"]


@query(f"select id, {_CELLS}, 80 as margin from {_OR}")
def parse_month_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misread month names count for less, but are found."""
    name = F.element_at(F.array(*[F.lit(m) for m in _MISREAD]), F.month("d"))
    return _resolve(_orders(spark, sf_dir), F.concat(_fmt("dd "), name, _fmt(" yyyy")), more=("margin",))


@query(f"select id, strftime(d, '%Y') as year, strftime(d, '%m') as month, 'NONE' as day, strftime(d, '%Y-%m') || '-NONE' as final_date from {_OR}")
def parse_partial_ym(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year and month, or month and year: no day."""
    k = F.col("id") % 3
    return _resolve(_orders(spark, sf_dir), F.when(k == 0, _fmt("yyyy.MM")).when(k == 1, _fmt("MM/yyyy")).otherwise(F.upper(_fmt("MMM yyyy"))))


@query(f"select id, 'NONE' as year, strftime(d, '%m') as month, strftime(d, '%d') as day, 'NONE-' || strftime(d, '%m-%d') as final_date from {_EV}")
def parse_partial_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolve(_events(spark, sf_dir), _fmt("MM.dd"))


@query(f"select id, {_CELLS}, -5 as margin from {_EV}")
def parse_fallback6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six digits are a date only where there is no other."""
    return _resolve(_events(spark, sf_dir), _fmt("yyMMdd"), more=("margin",))


@query(f"""select id, line, year, month, day, {_FINAL} from (select id, line, strftime(d, '%Y') as year, strftime(d, '%m') as month,
 case when (id + line) % 5 = 4 then 'NONE' else strftime(d, '%d') end as day from {_LI})""")
def parse_misread_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes with lost separators and stray characters."""
    k = (F.col("id") + F.col("line")) % 5
    text = F.when(k == 0, F.concat(_fmt("yyyyMM.dd"), F.lit("7"))).when(k == 1, F.concat(F.lit("EXP:"), _fmt("dd/MMyyyy"))).when(k == 2, F.concat(_fmt("yyyy.MM.dd"), F.lit("0A5"))).when(k == 3, F.concat(_fmt("yyyy.MM"), F.lit("X"), _fmt("dd"))).otherwise(_fmt("MM/yyyy"))
    return _resolve(_lines(spark, sf_dir), text, keys=("id", "line"))


@query(f"""select id, year, month, day, {_FINAL} from (select id, case when id % 7 = 0 then strftime(d, '%Y') else 'NONE' end as year,
 case when id % 7 = 0 then '02' else strftime(was, '%m') end as month, case when id % 7 = 0 then 'NONE' else strftime(was, '%d') end as day from {_OR})""")
def parse_invalid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only impossible cells go: years out of range, and the 30th of February."""
    return _resolve(_orders(spark, sf_dir), F.when(F.col("id") % 7 == 0, F.concat(_fmt("yyyy"), F.lit(".02.30"))).otherwise(F.date_format("was", "yyyy.MM.dd")))


@query(f"""select id, 'LOT       X ' || strftime(d, '%Y.%m.%d') as kept, 5 as n_dropped,
 '12:' || lpad(cast(id % 60 as varchar), 2, '0') || '|010-1234-' || lpad(cast(id % 10000 as varchar), 4, '0') || '|' || '880' || lpad(cast(id as varchar), 10, '0') || '|1,' || lpad(cast(id % 1000 as varchar), 3, '0') || '|' || cast(id % 500 as varchar) || 'ML' as dropped,
 {_CELLS} from {_EV}""")
def noise_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock times, phone numbers, barcodes, amounts and nutrition go; the date stays."""
    n = lambda m, w: F.format_string(f"%0{w}d", F.col("id") % m)
    text = F.concat(F.lit("LOT 12:"), n(60, 2), F.lit(" 010-1234-"), n(10000, 4), F.lit(" 880"), F.format_string("%010d", "id"), F.lit(" 1,"), n(1000, 3), F.lit(" "), (F.col("id") % 500).cast("string"), F.lit("ML X "), _fmt("yyyy.MM.dd"))
    df = hold(_events(spark, sf_dir), text=text)
    cells = _resolve(df, F.col("text"), keys=("id", "text"))
    return cells.select("id", F.regexp_replace(strip_noise(F.col("text")), " +X", "       X").alias("kept"), F.size(noise(F.col("text"))).alias("n_dropped"), F.array_join(F.transform(noise(F.col("text")), lambda x: x["text"]), "|").alias("dropped"), "year", "month", "day", "final_date")


@query(f"select id, {_CELLS}, 8 as margin from {_EV}")
def split_token_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date over three tokens."""
    return _resolve(_events(spark, sf_dir), F.lit("LOT"), _fmt("yyyy"), _fmt("MM"), _fmt("dd"), F.lit("A1"), more=("margin",))


@query(f"""with t as (select id, line, l_partkey, l_suppkey, case when (l_partkey + line) % 4 = 0 then 'W' || line else cast(l_partkey % 3000 as varchar) end as tok from {_LI}),
 n as (select *, row_number() over (partition by id order by line, l_partkey, l_suppkey) as p, (tok not like 'W%') as num from t),
 i as (select *, p - row_number() over (partition by id, num order by p) as island, max(case when not num then p end) over (partition by id order by p) as wordp from n),
 w as (select id, wordp, tok as a, lead(tok, 1) over k as b, lead(tok, 2) over k as c from i where num window k as (partition by id, island order by p))
select w.id, cast(a as integer) as a, cast(b as integer) as b, cast(c as integer) as c, coalesce(n.tok, '') as ctx, case when length(a) = 4 or length(b) = 4 or length(c) = 4 then 6 else 0 end as bonus
from w left join n on n.id = w.id and n.p = w.wordp where c is not null""")
def adjacent_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three within runs of numeric tokens, with the token before the run."""
    tok = F.when((F.col("l_partkey") + F.col("line")) % 4 == 0, F.concat(F.lit("W"), F.col("line").cast("string"))).otherwise((F.col("l_partkey") % 3000).cast("string"))
    rows = _lines(spark, sf_dir).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "l_partkey", "l_suppkey", tok.alias("tok")))), lambda x: x["tok"]).alias("_norm"))
    return joined_triples(rows).select("id", F.inline("_joins"))


@query(f"""select id, strftime(s, '%Y') as year, strftime(s, '%m') as month, strftime(s, '%d') as day, strftime(s, '%Y-%m-%d') as final_date, 65 as margin
from (select o.id, o.d, min(l.d) as s from {_OR} o join {_LI} l on o.id = l.id group by 1, 2)""")
def expiry_vs_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manufacturing and an expiry date: the latter wins, by 50 to -15."""
    ship = _lines(spark, sf_dir).groupBy("id").agg(F.min("d").alias("s"))
    return _resolve(_orders(spark, sf_dir).join(ship, "id"), F.concat(F.lit("MFG "), _fmt("yyyy.MM.dd")), F.concat(F.lit("EXP "), _fmt("yyyy.MM.dd", "s")), more=("margin",))


@query(f"""with v as (select id, d, count(distinct (l_suppkey % 3)) as votes from {_LI} group by 1, 2), r as (select *, row_number() over (partition by id order by d desc) as k from v)
select id, {_CELLS}, cast(votes as integer) as votes from r where k = 1""")
def candidate_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reading paths gave the winning date."""
    items = F.array_sort(F.collect_list(F.struct("line", _fmt("yyyy.MM.dd").alias("text"), F.concat(F.lit("scale"), (F.col("l_suppkey") % 3).cast("string")).alias("src"))))
    rows = _lines(spark, sf_dir).groupBy("id").agg(F.transform(items, lambda x: F.struct(x["text"].alias("text"), x["src"].alias("src"))).alias("items"))
    return resolve_dates(rows, CONFIG).select("id", "year", "month", "day", "final_date", "votes")


@query(f"""with c as (select id, line, d, case line % 3 when 0 then 20 when 1 then 50 else -15 end as score from {_LI}),
 r as (select *, row_number() over w as k, lead(score) over w as nxt from c window w as (partition by id order by score desc, d desc, line)),
 a as (select id, string_agg(strftime(d, '%Y-%m-%d') || '(' || score || ')', ' ' order by k) as alts from r where k between 2 and 4 group by 1)
select r.id, {_CELLS}, cast(score - coalesce(nxt, 0) as integer) as margin, coalesce(a.alts, '') as alts from r left join a on a.id = r.id where k = 1""")
def candidate_topk_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking of several dates, margin to the second, and the next three."""
    k = F.col("line") % 3
    text = F.concat(F.when(k == 0, "").when(k == 1, "EXP ").otherwise("MFG "), _fmt("yyyy.MM.dd"), F.when(k == 0, F.concat(F.lit(" L"), F.col("line").cast("string"))).otherwise(""))
    items = F.array_sort(F.collect_list(F.struct("line", text.alias("text"))))
    rows = _lines(spark, sf_dir).groupBy("id").agg(F.transform(items, lambda x: F.struct(x["text"].alias("text"), F.lit(None).cast("string").alias("src"))).alias("items"))
    # an image whose dates are all in one context takes expiry words from anywhere, which changes nothing here
    return resolve_dates(rows, CONFIG).select("id", "year", "month", "day", "final_date", "margin", F.array_join("alts", " ").alias("alts"))


@query(f"select id, line, cast(place as integer) as place from (select id, line, row_number() over (partition by id order by l_quantity desc, line, l_partkey, l_suppkey) as place from {_LI}) where place <= 6")
def widest_boxes_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widest(_lines(spark, sf_dir), 6, by=("id",), width=F.col("l_quantity"), order=("line", "l_partkey", "l_suppkey")).select("id", "line", "place")


@query(f"""with b as (select id, line, row_number() over (partition by id order by line, l_partkey, l_suppkey) as seq, l_partkey % 200 as x0, l_suppkey % 50 as y0, (l_partkey % 200) + cast(l_quantity as integer) as x1, (l_suppkey % 50) + 10 as y1, case when (id + line) % 3 = 0 then 'A' else 'A1' end as t from {_LI}),
 m as (select *, max(case when t = 'A1' then 1 else 0 end) over (partition by id) as has from b),
 w as (select *, row_number() over (partition by id order by x1 - x0 desc, seq) as p from m where has = 0 or t = 'A1'),
 c as (select id, p, greatest(0, cast(trunc(x0 - ((x1 - x0) * 0.35 + 12)) as integer)) as cx0, greatest(0, cast(trunc(y0 - ((y1 - y0) * 0.9 + 12)) as integer)) as cy0, least(220, cast(trunc(x1 + (x1 - x0) * 0.35 + 12) as integer)) as cx1, least(60, cast(trunc(y1 + (y1 - y0) * 0.9 + 12) as integer)) as cy1 from w where p <= 6)
select id, cx0, cy0, cx1, cy1, cast(row_number() over (partition by id order by p) as integer) as place from c where cx1 - cx0 >= 12 and cy1 - cy0 >= 8""")
def crop_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops around the widest boxes with a digit."""
    seq = F.row_number().over(W.partitionBy("id").orderBy("line", "l_partkey", "l_suppkey"))
    x0, y0 = (F.col("l_partkey") % 200).cast("int"), (F.col("l_suppkey") % 50).cast("int")
    boxes = _lines(spark, sf_dir).select(F.col("id").alias("image_id"), F.lit(0).alias("stage_ord"), seq.alias("box_seq"), F.when((F.col("id") + F.col("line")) % 3 == 0, "A").otherwise("A1").alias("text"), F.array(x0, y0, x0 + F.col("l_quantity").cast("int"), y0 + 10).alias("box"), F.lit(220).alias("width"), F.lit(60).alias("height"))
    c = crop_boxes(boxes)
    return c.select(F.col("image_id").alias("id"), *[F.get("crop", F.lit(i)).alias(n) for i, n in enumerate(("cx0", "cy0", "cx1", "cy1"))], "place")


@query(f"select id, {_CELLS} from {_EV}")
def rescue_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that the first pass leaves open and the second one reads."""
    k = F.col("id") % 5
    y = _fmt("yy")
    text = F.when(k == 0, F.concat(y, y, _fmt(".MM.dd"))).when(k == 1, F.concat(_fmt("yyyy.MM.dd"), F.lit("17"))).when(k == 2, _fmt("yyyy.MMdd")).when(k == 3, F.concat(_fmt("yy MM dd"), F.lit("D218"))).otherwise(F.upper(_fmt("MMMddyyyy")))
    return _resolve(_events(spark, sf_dir), text)


@query(f"""select id, year, month, day, {_FINAL} from (select id, case when day(d) between 19 and 27 then '20' || strftime(d, '%d') else strftime(d, '%Y') end as year,
 case when day(d) <= 12 then strftime(d, '%d') else strftime(d, '%m') end as month,
 case when day(d) between 19 and 27 then strftime(d, '%y') when day(d) <= 12 then strftime(d, '%m') else strftime(d, '%d') end as day from {_EV})""")
def us_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day and month change places on goods with a barcode of the Americas, or their words."""
    return _resolve(_events(spark, sf_dir), _fmt("dd.MM.yy"), F.when(F.col("id") % 2 == 0, "012345678905").otherwise("NET WT 12"))


@query(f"select id, {_CELLS} from {_EV}")
def eu_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-digit years are behind on European goods."""
    return _resolve(_events(spark, sf_dir), F.lit("CONSUMIR ANTES"), _fmt("dd-MM-yy"))


@query(f"select id, cast(year(d) + 1 as varchar) as year, strftime(d, '%m') as month, strftime(d, '%d') as day, cast(year(d) + 1 as varchar) || strftime(d, '-%m-%d') as final_date from {_EV}")
def exp_over_prod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later expiry date without separators beats the production date."""
    return _resolve(_events(spark, sf_dir), F.concat(F.lit("PROD "), _fmt("yyyy.MM.dd")), F.concat(F.lit("EXP"), _fmt("ddMM"), F.format_string("%02d", F.year("d") % 100 + 1)))


@query(f"""select id, year, month, day, {_FINAL} from (select id, strftime(d, '%Y') as year, case when id % 3 = 2 then '09' else strftime(d, '%m') end as month, strftime(d, '%d') as day from {_EV})""")
def dot_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misreadings of dot-matrix prints."""
    k = F.col("id") % 3
    m = F.month("d").cast("string")
    text = F.when(k == 0, F.concat(_fmt("yyyy.6"), m, _fmt(".dd"))).when(k == 1, F.concat(_fmt("yyyy"), F.lit("W"), m, _fmt(".dd"))).otherwise(F.concat(F.lit("9EP "), _fmt("dd yyyy")))
    return _resolve(_events(spark, sf_dir), text)


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _orders(spark, sf_dir)
    return d.select(F.col("id"), F.col("id").cast("string").alias("image_id"), _fmt("yyyy").alias("year"), _fmt("MM").alias("month"), _fmt("dd").alias("day"), F.when(F.col("id") % 11 == 0, "NONE").otherwise(_fmt("yyyy-MM-dd")).alias("final_date"))


def _run(spark: SparkSession, sf_dir: str, wrong: int) -> DataFrame:
    """Predictions that are off for ids by their remainder to wrong."""
    k = F.col("id") % wrong
    g = _gold(spark, sf_dir)
    cell = lambda c, off: F.when(k == 1, "NONE").when(k == off, F.lit("NONE" if off == 2 else "01")).otherwise(F.col(c))
    return g.select(F.when(F.col("id") % 2 == 0, zero_fill(F.col("image_id"))).otherwise(F.col("image_id")).alias("image_id"), cell("year", 2).alias("year"), F.when(k == 1, "NONE").otherwise(F.col("month")).alias("month"), cell("day", 3).alias("day"), ((F.col("id") % 97) / 10).alias("sec"), F.when(F.col("id") % 50 == 0, -1.0).when(F.col("id") % 9 == 0, 1.5).when(F.col("id") % 7 == 0, 1.0).otherwise(0.0).alias("stage"))


_GOLD = f"(select id, strftime(d, '%Y') as year, strftime(d, '%m') as month, strftime(d, '%d') as day, case when id % 11 = 0 then 'NONE' else strftime(d, '%Y-%m-%d') end as final_date from {_OR})"


def _run_sql(wrong: int) -> str:
    return f"(select id, case when id % {wrong} in (1, 2) then 'NONE' else year end as year, case when id % {wrong} = 1 then 'NONE' else month end as month, case when id % {wrong} = 1 then 'NONE' when id % {wrong} = 3 then '01' else day end as day, (id % 97) / 10.0::double as sec, case when id % 50 = 0 then -1.0 when id % 9 = 0 then 1.5 when id % 7 = 0 then 1.0 else 0.0 end::double as stage from {_GOLD})"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir).drop("id").withColumn("image_id", F.when(F.length("image_id") < 6, F.lpad("image_id", 6, "0")).otherwise(F.col("image_id")))


_OK = "(p.year = g.year and p.month = g.month and p.day = g.day)"


@query(f"""select count(*) as n, count(*) filter (where {_OK}) as "full", round(100.0 * count(*) filter (where {_OK}) / count(*), 2) as full_pct,
 round(100.0 * sum((p.year = g.year)::int + (p.month = g.month)::int + (p.day = g.day)::int) / (3 * count(*)), 2)::double as cells_pct,
 count(*) filter (where g.final_date = 'NONE' and p.year <> 'NONE' and p.month <> 'NONE' and p.day <> 'NONE') as false_positive,
 count(*) filter (where p.year = 'NONE' and p.month = 'NONE' and p.day = 'NONE') as miss_all_none,
 round(avg(p.sec), 2) as sec_mean, list_sort(list(p.sec))[count(*) // 2 + 1] as sec_median, max(p.sec) as sec_max, round(round(avg(p.sec), 2) * 500 / 4 / 60, 1) as min_4core_500
 from {_run_sql(10)} p join {_GOLD} g on p.id = g.id""")
def score_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score(_run(spark, sf_dir, 10), _labels(spark, sf_dir))


@query(f"select stage, count(*) as images, round(100.0 * count(*) / (select count(*) from orders), 1) as share_pct, case when stage < 0 then count(*) else 0 end as errors from {_run_sql(10)} group by stage")
def stage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.stage_histogram(_run(spark, sf_dir, 10))


def _padded(df: DataFrame) -> DataFrame:
    return df.withColumn("image_id", F.when(F.length("image_id") < 6, F.lpad("image_id", 6, "0")).otherwise(F.col("image_id")))


@query(f"""select count(*) filter (where a and not b) as gain, count(*) filter (where b and not a) as lose from
 (select {_OK} as a, (q.year = g.year and q.month = g.month and q.day = g.day) as b from {_run_sql(10)} p join {_run_sql(7)} q on p.id = q.id join {_GOLD} g on p.id = g.id)""")
def gain_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gain_loss(_padded(_run(spark, sf_dir, 10)), _padded(_run(spark, sf_dir, 7)), _labels(spark, sf_dir))


@query(f"""select image_id, change, gold, base, new from (select case when length(cast(p.id as varchar)) < 6 then lpad(cast(p.id as varchar), 6, '0') else cast(p.id as varchar) end as image_id, {_OK} as a, (q.year = g.year and q.month = g.month and q.day = g.day) as b,
 case when {_OK} then 'gain' else 'lose' end as change, g.final_date as gold, q.year || '-' || q.month || '-' || q.day as base, p.year || '-' || p.month || '-' || p.day as new
 from {_run_sql(10)} p join {_run_sql(7)} q on p.id = q.id join {_GOLD} g on p.id = g.id) where a <> b""")
def run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.changes(_padded(_run(spark, sf_dir, 10)), _padded(_run(spark, sf_dir, 7)), _labels(spark, sf_dir))


@query("select cast(o_orderkey as varchar) as image_id from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_linenumber = 4)")
def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("image_id"))
    log = _t(spark, sf_dir, "lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").cast("string").alias("image_id"))
    return evaluate.todo(images, log)


@query(f"select id, case when id % 7 < 5 then 'NONE' else strftime(d, '%Y') end as cell from {_OR}")
def normalise_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 7
    raw = F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 2, " nan ").when(k == 3, "-").when(k == 4, "None").when(k == 5, F.concat(F.lit(" "), _fmt("yyyy"), F.lit(" "))).otherwise(_fmt("yyyy"))
    return _orders(spark, sf_dir).select("id", clean_cell(raw).alias("cell"))


@query('select true as header_ok, count(*) as "rows", true as rows_ok, count(*) > 0 as not_empty, count(*) filter (where o_orderkey % 5 = 0) as bad_form, count(*) filter (where o_orderkey % 5 = 0) = 0 as ok from orders')
def self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gold(spark, sf_dir).withColumn("final_date", F.when(F.col("id") % 5 == 0, "2026-05").otherwise(F.col("final_date"))).select(*fixed.PREDICTION)
    return evaluate.self_check(rows, _t(spark, sf_dir, "orders").count())


@query(r"""select doc_id, regexp_matches(text, '[0-9]{1,4}\s*[./\-]\s*[0-9]{1,2}\s*[./\-]\s*[0-9]{1,4}|(^|[^0-9])[0-9]{6,8}($|[^0-9])|(?i:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)') as date_shaped, regexp_matches(text, '[0-9]') as has_digit from documents""")
def date_shaped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", date_shaped(F.col("text")).alias("date_shaped"), has_digit(F.col("text")).alias("has_digit"))


_EXITS = [("scale1280", 0.0), ("clahe1280", 0.0), ("rot90", 1.0), ("bin_dilate1280", 1.5), ("crop", 2.0), ("enhance", 4.0), ("", 4.0)]


def scripted_engine(image: dict, src: str, crop: list[int] | None) -> list[dict]:
    """A reading engine that finds a whole date at one rung, by the image's number, and a lone number before; every eighth fails."""
    n = int(image["image_id"])
    if n % 8 == 7:
        raise ValueError("unreadable")
    hit = src == _EXITS[n % 8][0]
    return [{"text": "2026.05.29" if hit else "77", "conf": 0.9, "polygon": [[0, 0], [60, 0], [60, 20], [0, 20]]}]


@query("select cast(s_suppkey as varchar) as image_id, case when s_suppkey % 8 < 6 then '2026-05-29' else 'NONE' end as final_date, case s_suppkey % 8 " + " ".join(f"when {i} then {s}" for i, (_, s) in enumerate(_EXITS)) + " else -1.0 end::double as stage from supplier")
def ladder_exit_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rung at which each image leaves, with a scripted engine."""
    images = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("image_id"), F.lit(1600).alias("width"), F.lit(1200).alias("height"))
    results, _ = run_ladder(images, scripted_engine, CONFIG)
    return results.select("image_id", "final_date", "stage")


@query(f"select cast(id as varchar) as image_id, case when id % 7 < 5 then 'NONE' else strftime(d, '%Y') end as year, strftime(d, '%m') as month, strftime(d, '%d') as day, strftime(d, '%Y-%m-%d') as final_date from {_OR}")
def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five output columns."""
    from ..sources.files import predictions

    k = F.col("id") % 7
    raw = F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 2, " nan ").when(k == 3, "-").when(k == 4, "null").otherwise(_fmt("yyyy"))
    return predictions(_orders(spark, sf_dir).select(F.col("id").alias("image_id"), raw.alias("year"), _fmt("MM").alias("month"), _fmt("dd").alias("day"), _fmt("yyyy-MM-dd").alias("final_date")))


@query(f"""select id, {_CELLS}, case id % 3 when 0 then '{fixed.RULES["YMD"]}' when 1 then '{fixed.RULES["YMD"]} + {fixed.WHY["expiry"]}' else '{fixed.RULES["YMD"]} + {fixed.WHY["made"]}' end as rule,
 case id % 3 when 0 then 0.62 when 1 then 0.87 else 0.33 end::double as score, case id % 3 when 0 then 20 when 1 then 50 else -15 end as margin from {_EV}""")
def rule_and_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a date was taken, and how sure that is."""
    k = F.col("id") % 3
    return _resolve(_events(spark, sf_dir), F.concat(F.when(k == 0, "").when(k == 1, "EXP ").otherwise("MFG "), _fmt("yyyy.MM.dd")), more=("rule", "score", "margin"))


@query(f"select id, {_CELLS} from {_EV}")
def parse_full_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width digits and separators, by NFKC in Arrow batches."""
    wide = F.translate(_fmt("yyyy.MM.dd"), "0123456789.", "０１２３４５６７８９．")
    return _resolve(_events(spark, sf_dir), wide, config=LabelConfig(as_of_year=2026))


@query(f"select id, string_agg(strftime(d, '%Y-%-m-%-d'), ' ' order by d desc, line) as cands from {_LI} group by id")
def all_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates in the order of their rank."""
    items = F.array_sort(F.collect_list(F.struct("line", _fmt("yyyy.MM.dd").alias("text"))))
    rows = _lines(spark, sf_dir).groupBy("id").agg(F.transform(items, lambda x: F.struct(x["text"].alias("text"), F.lit(None).cast("string").alias("src"))).alias("items"))
    return resolve_dates(rows, CONFIG).select("id", F.array_join(F.transform("all_cands", lambda c: F.concat_ws("-", c["y"], c["m"], c["d"])), " ").alias("cands"))


@query(f"select id, {_CELLS}, 140 as margin from {_EV}")
def month_in_next_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month's name whose numbers are in the tokens beside it: found through the neighbours, for 30 points less."""
    return _resolve(_events(spark, sf_dir), _fmt("dd"), F.upper(_fmt("MMM")), _fmt("yyyy"), more=("margin",))


@query(f"select id, 'NONE' as year, strftime(d, '%m') as month, 'NONE' as day, 'NONE-' || strftime(d, '%m') || '-NONE' as final_date, 5 as margin from {_OR}")
def month_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month's name without any number is a month."""
    return _resolve(_orders(spark, sf_dir), F.concat(F.lit("BEST "), F.upper(_fmt("MMM"))), more=("margin",))


@query(f"select id, {_CELLS}, 2 as votes from {_EV}")
def vote_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reading paths that agree beat a later date of one, where votes earn points."""
    later = F.date_format(F.add_months("d", 12), "yyyy.MM.dd")
    items = F.array(*[F.struct(t.alias("text"), F.lit(s).alias("src")) for t, s in ((_fmt("yyyy.MM.dd"), "scale800"), (later, "scale800"), (_fmt("yyyy.MM.dd"), "rot90"))])
    rows = _spread(_events(spark, sf_dir).select("id", items.alias("items")))
    return resolve_dates(rows, LabelConfig(as_of_year=2026, nfkc="native", votes=((2, 15),))).select("id", "year", "month", "day", "final_date", "votes")


@query(f"select id, {_CELLS}, 20 as margin from {_EV}")
def parse_joined_year_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year and month without a separator, then the day."""
    return _resolve(_events(spark, sf_dir), _fmt("yyyyMM.dd"), more=("margin",))


@query(f"select id, line, l_partkey % 200 * 2 + 3 as x0, l_suppkey % 50 * 2 + 1 as y0, (l_partkey % 200 + cast(l_quantity as integer)) * 2 + 3 as x1, (l_suppkey % 50 + 10) * 2 + 1 as y1 from {_LI}")
def box_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons to bounding boxes, scaled and shifted."""
    from ..operators.boxes import bounding_box

    n = lambda c: c.cast("double")
    x0, y0, q = n(F.col("l_partkey") % 200), n(F.col("l_suppkey") % 50), n(F.col("l_quantity").cast("int"))
    polygon = F.array(F.array(x0 + 0.25, y0 + 10), F.array(x0 + q, y0 + 0.25), F.array(x0, y0), F.array(x0 + q, y0 + 10))
    box = bounding_box(polygon, F.lit(2.0), F.lit(2.0), F.lit(3.0), F.lit(1.0))
    return _lines(spark, sf_dir).select("id", "line", *[F.get(box, F.lit(i)).cast("long").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@query("select s_suppkey as id, cast(s_suppkey as varchar) || '.x' as image_id from supplier")
def image_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from the paths of files."""
    from ..sources.files import image_id

    k = F.col("s_suppkey").cast("string")
    return _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), image_id(F.concat(F.lit("file:/a.b/"), k, F.lit(".x"), F.when(F.col("s_suppkey") % 2 == 0, ".JPG").otherwise(".png"))).alias("image_id"))


_ID = "case when length(cast(id as varchar)) < 6 then lpad(cast(id as varchar), 6, '0') else cast(id as varchar) end"


def _folder(spark: SparkSession) -> str:
    import uuid

    from ..sources.stored import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@query(f"select {_ID} as image_id, year, month, day, final_date from {_GOLD}")
def labels_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written as CSV and read again as labels."""
    from ..sources.files import read_labels, write_predictions

    folder = _folder(spark)
    write_predictions(_gold(spark, sf_dir), folder)
    return read_labels(spark, folder)


@query(f"select {_ID} as image_id, year, month, day, sec, stage from {_run_sql(10)}")
def run_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log added to twice, with a line that doesn't parse, read again, and of each image the last row."""
    from ..sources.files import append_run_log, last_runs, read_run_log

    folder = _folder(spark)
    run = _padded(_run(spark, sf_dir, 10))
    append_run_log(run.where("stage < 1").withColumn("sec", F.lit(-1.0)), folder)
    append_run_log(run, folder)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(folder)
    return last_runs(read_run_log(spark, folder), "sec").select("image_id", "year", "month", "day", "sec", "stage")
