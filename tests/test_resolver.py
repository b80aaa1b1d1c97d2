"""The resolver on printed shapes, one case a rule."""

import pytest
from pyspark.sql import functions as F

from shelfdate.functions.dates import LabelConfig
from shelfdate.functions.fixed import month_spellings
from shelfdate.plans.resolver import resolve_core_only, resolve_dates, tokens_from_boxes

CONFIG = LabelConfig(as_of_year=2026)
CASES = [
    ([], "NONE"), (["2026.05.29"], "2026-05-29"), (["EXP:26/062026"], "2026-06-26"), (["202807.257"], "2028-07-25"), (["2021.09.030A5"], "2021-09-03"), (["2023.01X13"], "2023-01-13"), (["12/2021"], "2021-12-NONE"), (["SEP 2022"], "2022-09-NONE"),
    (["10.18"], "NONE-10-18"), (["20260529"], "2026-05-29"), (["28082022"], "2022-08-28"), (["2021", "03", "14"], "2021-03-14"), (["MFG", "21", "03", "14"], "2021-03-14"), (["EXP 15 JAN 2027"], "2027-01-15"), (["MFG 2026.01.02", "EXP 2026.07.02"], "2026-07-02"),
    (["260529"], "2026-05-29"), (["2026.02.30"], "2026-02-NONE"), (["2024.02.29"], "2024-02-29"), (["2026.18"], "2026-NONE-18"), (["29.03.02"], "NONE"), (["26:09:16"], "2026-09-16"), (["LOT 12:30", "2027.01.05"], "2027-01-05"), (["2626.08.13"], "2026-08-13"),
    (["2022.0825"], "2022-08-25"), (["24 09 26D218"], "2024-09-26"), (["AUG162022"], "2022-08-16"), (["USEBYMAY2421"], "NONE"), (["05.03.26", "012345678905"], "2026-05-03"), (["05.03.26", "NET WT"], "2026-05-03"), (["05.03.26"], "2026-03-05"),
    (["CONSUMIR ANTES", "20-09-21"], "2021-09-20"), (["CONSUMIR 까지", "20-09-21"], "2020-09-21"), (["2026.61.15"], "2026-01-15"), (["2026W1.15"], "2026-01-15"), (["9EP 05 2026"], "2026-09-05"), (["PROD 2024.01.15", "EXP150125"], "2025-01-15"),
    (["２０２６．０５．２９"], "2026-05-29"), (["2026·05·29"], "2026-05-29"), (["202110.20"], "2021-10-20"), (["15 5EP 2027"], "2027-09-15"), (["JAN", "15", "2027"], "NONE-01-NONE"), (["까지", "2026.01.02"], "2026-01-02"), (["WAR 12 2026"], "NONE"),
    (["30/08/202"], "2020-08-30"), (["22.01.1122119"], "2022-01-11"), (["12026.05.29"], "2026-05-29"),
]


@pytest.fixture(scope="module")
def resolved(spark):
    rows = [(i, [(t, None) for t in tokens]) for i, (tokens, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "image_id int, items array<struct<text:string,src:string>>")
    return {r.image_id: r for r in resolve_dates(df, CONFIG).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_printed_shapes(resolved, i):
    tokens, expected = CASES[i]
    assert resolved[i].final_date == expected, tokens


def test_scores_margins_and_rules(resolved):
    by = {tuple(t): resolved[i] for i, (t, _) in enumerate(CASES)}
    two = by["MFG 2026.01.02", "EXP 2026.07.02"]
    assert (two.margin, two.score, two.alts) == (65, 0.99, ["2026-01-02(-15)"])
    assert by["2026.05.29",].margin == 20
    assert by["MFG", "21", "03", "14"].margin == -33
    assert by["EXP 15 JAN 2027",].margin == 200
    assert by["260529",].margin == -5
    empty = by[()]
    assert (empty.score, empty.margin, empty.votes, empty.alts, empty.all_cands) == (0.0, 0, None, [], [])
    assert [d.text for d in by["LOT 12:30", "2027.01.05"].dropped] == ["12:30"]


def test_month_spellings():
    known = month_spellings()
    assert len(known) == 124
    assert known["IAN"] == 1 and known["SEPTEMBER"] == 9 and known["MAV"] == 5 and "WAR" not in known


def test_votes_count_paths_and_nulls_alike(spark):
    rows = [(1, [("10.18", "scale800"), ("10.18", "rot90"), ("10.18", "rot90")]), (2, [("2026.05.29", None)]), (3, None), (4, [(None, None), ("2026.05.29", "crop")])]
    df = spark.createDataFrame(rows, "image_id int, items array<struct<text:string,src:string>>")
    out = {r.image_id: r for r in resolve_dates(df, CONFIG).collect()}
    assert (out[1].votes, out[2].votes, out[4].votes) == (2, 0, 1)
    assert out[1].final_date == "NONE-10-18" and out[1].rule.endswith("2개 경로 일치")
    assert out[3].final_date == "NONE" and out[4].final_date == "2026-05-29"
    bonus = {r.image_id: r for r in resolve_dates(df, LabelConfig(as_of_year=2026, votes=((2, 4),))).collect()}
    assert bonus[1].margin == 0 and bonus[4].margin == 20


def test_core_without_overrides(spark):
    df = spark.createDataFrame([(1, [("2026.61.15", None)])], "image_id int, items array<struct<text:string,src:string>>")
    r = resolve_core_only(df, CONFIG).collect()[0]
    assert (r.final_date, r.year, r.month, r.day) == ("NONE", "2026", "NONE", "NONE")


def test_year_window_moves(spark):
    df = spark.createDataFrame([(1, [("28.05.29", None)])], "image_id int, items array<struct<text:string,src:string>>")
    assert resolve_dates(df, LabelConfig(as_of_year=2026)).first().final_date == "NONE"
    assert resolve_dates(df, LabelConfig(as_of_year=2028)).first().final_date == "2028-05-29"


def test_tokens_keep_reading_order(spark):
    boxes = spark.createDataFrame([("a", 1, 0, "14", "x"), ("a", 0, 1, "03", "x"), ("a", 0, 0, "2021", "x")], "image_id string, stage_ord int, box_seq int, text string, src string")
    items = tokens_from_boxes(boxes).first().items
    assert [i.text for i in items] == ["2021", "03", "14"]
    assert resolve_dates(tokens_from_boxes(boxes), CONFIG).first().final_date == "2021-03-14"


def test_no_shuffle_within_the_resolver(spark):
    df = spark.range(10).select(F.col("id").alias("image_id"), F.array(F.struct(F.lit("2026.05.29").alias("text"), F.lit(None).cast("string").alias("src"))).alias("items"))
    plan = resolve_dates(df, LabelConfig(as_of_year=2026, nfkc="native"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
