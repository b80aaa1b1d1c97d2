"""The ladder with a scripted engine, sources, sinks, evaluation and the running score."""

import json

from pyspark.sql import functions as F

from shelfdate.functions.dates import LabelConfig
from shelfdate.operators import evaluate
from shelfdate.operators.boxes import crop_boxes
from shelfdate.plans.ladder import budget, run_ladder
from shelfdate.sources import files

CONFIG = LabelConfig(as_of_year=2026, nfkc="native")
HITS = {"a": "scale800", "b": "clahe1280", "c": "rot90", "d": "crop", "e": "none", "f": "small", "g": "error", "h": "partial"}


def scripted():
    """An engine that goes to the workers by value."""
    hits = dict(HITS)

    def engine(image, src, crop):
        name = image["image_id"]
        if name == "g":
            raise RuntimeError("broken")
        if src == "bin_dilate1280" and name == "e":
            raise RuntimeError("ignored")
        box = {"text": "lot 7", "conf": 0.91234, "polygon": [[1.9, 2.9], [40.2, 2.0], [40.2, 12.0], [1.0, 12.0]], "sx": 2.0, "sy": 2.0}
        if src == hits[name] or (name == "f" and src == "clahe1280"):
            box["text"] = "2026.05.29"
        if name == "h" and src == "scale800":
            box["text"] = "2026.05"
        return [box]

    return engine


def test_ladder_exits(spark):
    images = spark.createDataFrame([(k, 300 if k == "f" else 1600, 200 if k == "f" else 1200) for k in HITS], "image_id string, width int, height int")
    results, boxes = run_ladder(images, scripted(), CONFIG)
    out = {r.image_id: (r.stage, r.final_date) for r in results.collect()}
    assert out == {"a": (0.0, "2026-05-29"), "b": (0.0, "2026-05-29"), "c": (1.0, "2026-05-29"), "d": (2.0, "2026-05-29"), "e": (4.0, "NONE"), "f": (0.0, "2026-05-29"), "g": (-1.0, "NONE"), "h": (1.5, "2026-05-NONE")}
    seen = {(r.image_id, r.src) for r in boxes.select("image_id", "src").collect()}
    assert ("a", "scale1280") not in seen and ("f", "scale800") not in seen and ("e", "up1920") not in seen and ("e", "enhance") in seen
    b = boxes.where("image_id = 'a'").first()
    assert (b.box, b.conf) == ([2, 4, 80, 24], 0.912)


def test_ladder_stops_at_max_stage(spark):
    images = spark.createDataFrame([("e", 1600, 1200)], "image_id string, width int, height int")
    assert run_ladder(images, scripted(), CONFIG, max_stage=0)[0].first().stage == 0.0


def test_an_image_leaves_when_its_time_is_up(spark):
    def engine(image, src, crop):
        import time

        time.sleep(0.4 if image["image_id"] == "slow" and src != "scale800" else 0)
        return [{"text": "lot 7", "polygon": [[0, 0], [9, 0], [9, 9], [0, 9]]}]

    images = spark.createDataFrame([("slow", 1600, 1200), ("quick", 1600, 1200)], "image_id string, width int, height int")
    results, boxes = run_ladder(images, engine, CONFIG, max_stage=1, seconds=0.3)
    out = {r.image_id: r for r in results.collect()}
    assert out["slow"].stage == 0.0 and out["quick"].stage == 1.0 and 0.4 <= out["slow"].sec < 2 and out["quick"].sec < 0.3
    assert {r.src for r in boxes.where("image_id = 'slow'").collect()} == {"scale800", "scale1280"}


def test_crops(spark):
    rows = [("a", 0, i, "n1" if i % 2 else "n", [10, 10, 10 + 5 * i, 20], 100, 50) for i in range(16)] + [("b", 0, 0, "x", [0, 0, 1, 1], 5, 5)]
    boxes = spark.createDataFrame(rows, "image_id string, stage_ord int, box_seq int, text string, box array<int>, width int, height int")
    out = crop_boxes(boxes).orderBy("image_id", "place").collect()
    assert [r.place for r in out] == [1, 2, 3, 4, 5, 6] and {r.image_id for r in out} == {"a"}
    assert out[0].crop == [0, 0, 100, 41]


def test_budget():
    assert budget(100) == 84.0 and budget(0) == 8400.0 and budget(10**6) == 4.0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "img").mkdir()
    for n in ("b.JPG", "a.png", "c.txt", "d.e.tiff"):
        (tmp_path / "img" / n).write_bytes(b"x")
    assert sorted(r.image_id for r in files.read_images(spark, str(tmp_path / "img")).collect()) == ["a", "b", "d.e"]
    assert files.read_images(spark, str(tmp_path / "img"), limit=1).count() == 1
    (tmp_path / "gold.csv").write_bytes(b"\xef\xbb\xbfimage_id,year,month,day,final_date\r\n7,2026,05,29,2026-05-29\r\n1234567,2026,NONE,NONE,NONE\r\n")
    assert sorted(tuple(r) for r in files.read_labels(spark, str(tmp_path / "gold.csv")).collect()) == [("000007", "2026", "05", "29", "2026-05-29"), ("1234567", "2026", "NONE", "NONE", "NONE")]
    rows = [("1", None, " nan ", "05", "x"), ("2", "2026", "-", "", "y")]
    df = spark.createDataFrame(rows, "image_id string, year string, month string, day string, final_date string")
    files.write_predictions(df, str(tmp_path / "out"), order="image_id")
    got = [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()]
    assert got == [("1", "NONE", "NONE", "05", "x"), ("2", "2026", "NONE", "NONE", "y")]
    assert files.predictions(df).columns == ["image_id", "year", "month", "day", "final_date"]


def log_row(i, day, stage=0, sec=1.0):
    return {"image_id": i, "year": "2026", "month": "05", "day": day, "final_date": f"2026-05-{day}", "rule": "r", "stage": stage, "sec": sec, "boxes": [{"text": "t", "conf": 0.5, "src": "crop", "box": [0, 0, 1, 1]}]}


def test_run_log_score_and_running_score(spark, tmp_path):
    from shelfdate.streaming.scores import running_score

    log = tmp_path / "log"
    log.mkdir()
    (log / "1.jsonl").write_text(json.dumps(log_row("000001", "29", sec=1.0)) + "\nnot json\n" + json.dumps(log_row("2", "28", 1.5, sec=3.0)) + "\n")
    run = files.read_run_log(spark, str(log))
    assert run.count() == 2
    gold = spark.createDataFrame([("000001", "2026", "05", "29", "NONE"), ("000002", "2026", "05", "29", "2026-05-29")], files.GOLD)
    s = evaluate.score(run, gold).first()
    assert (s.n, s.full, s.full_pct, s.cells_pct, s.false_positive, s.miss_all_none, s.sec_mean, s.sec_median, s.sec_max) == (2, 1, 50.0, 83.33, 1, 0, 2.0, 3.0, 3.0)
    assert evaluate.stage_map(run).first().stages == {"0": 1, "1.5": 1}
    q = running_score(spark, str(log), gold, str(tmp_path / "cp"), str(tmp_path / "scores"))
    q.awaitTermination()
    one = spark.read.parquet(str(tmp_path / "scores/scores"))
    assert [(r.batch, r.n, r.sec_median) for r in one.collect()] == [(0, 2, 3.0)]
    (log / "2.jsonl").write_text("".join(json.dumps(log_row(f"{i:06d}", "29", sec=0.5)) + "\n" for i in (1, 2, 2)))
    running_score(spark, str(log), gold, str(tmp_path / "cp"), str(tmp_path / "scores")).awaitTermination()
    two = {r.batch: r for r in spark.read.parquet(str(tmp_path / "scores/scores")).collect()}
    whole = evaluate.score(files.read_run_log(spark, str(log)), gold).first().asDict()
    assert two[0].n == 2 and {k: two[1][k] for k in whole} == whole and (two[1].n, two[1].sec_median) == (5, 0.5)
    assert evaluate.report(spark.createDataFrame([("r", *evaluate.score(run, gold).first())], "name string, n long, full long, full_pct double, cells_pct double, false_positive long, miss_all_none long, sec_mean double, sec_median double, sec_max double, min_4core_500 double")).first().line.startswith("r   ")


def test_score_of_nothing(spark):
    none = spark.createDataFrame([], files.RUN_LOG)
    gold = spark.createDataFrame([], files.GOLD)
    s = evaluate.score(none, gold).first()
    assert (s.n, s.full, s.full_pct, s.sec_median) == (0, 0, 0.0, None)
    assert evaluate.todo(spark.createDataFrame([("1",)], "image_id string"), none).count() == 1


def test_summaries(spark, tmp_path):
    (tmp_path / "x.summary.json").write_text(json.dumps({"n": 3, "full": 2, "stages": {"0": 3}, "cfg": {"thresh": 0.3}}, indent=1))
    (tmp_path / "smoke5.summary.json").write_text(json.dumps({"n": 1}))
    rows = files.read_summaries(spark, str(tmp_path)).collect()
    assert [(r.name, r.n, r.stages) for r in rows] == [("x", 3, {"0": 3})]


def test_last_run_and_changes(spark):
    log = spark.createDataFrame([("1", 1, "a"), ("1", 2, "b")], "image_id string, at int, v string")
    assert files.last_runs(log, "at").first().v == "b"
    cells = "image_id string, year string, month string, day string"
    run = spark.createDataFrame([("1", "2026", "05", "29"), ("2", "2026", "05", "01")], cells)
    base = spark.createDataFrame([("1", "NONE", "05", "29"), ("2", "2026", "05", "29")], cells)
    gold = spark.createDataFrame([("1", "2026", "05", "29", "2026-05-29"), ("2", "2026", "05", "29", "2026-05-29")], files.GOLD)
    assert sorted((r.image_id, r.change) for r in evaluate.changes(run, base, gold).collect()) == [("1", "gain"), ("2", "lose")]
    assert tuple(evaluate.gain_loss(run, base, gold).first()) == (1, 1)


def test_noise_and_pieces_of_text(spark):
    from shelfdate.functions.text import noise, strip_noise

    t = F.lit("AT 12:30 02-123-4567 8801234567890 1,234 250 ML X")
    r = spark.range(1).select(strip_noise(t).alias("k"), noise(t).alias("n")).first()
    assert r.k == "AT           X" and [x.text for x in r.n] == ["12:30", "02-123-4567", "8801234567890", "1,234", "250 ML"]
