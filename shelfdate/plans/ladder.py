"""The reading ladder: ever costlier readings of the images that have no whole date yet.

Reading is an injected function, engine(image, src, crop), run in mapInPandas for the images that still need it; deciding
is the resolver's native plan over all boxes so far. Each rung is written to the shared folder, so that rungs don't rerun.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import LabelConfig
from ..operators.boxes import bounding_box, crop_boxes
from ..sources.stored import written
from .resolver import resolve_dates, tokens_from_boxes

#: engine(image, src, crop) gives dicts: text, conf, polygon (list of x, y) and sx, sy, ox, oy back to the image.
Engine = Callable[[dict, str, list[int] | None], list[dict]]
_READ = "image_id string, text string, conf double, polygon array<array<double>>, sx double, sy double, ox double, oy double, seq int, error string, sec double"


@dataclass(frozen=True)
class Rung:
    """src: the reading's name; stage: what an exit here is called; soft: its errors are ignored; crop: which crop it reads."""

    src: str
    stage: float
    soft: bool = False
    crop: int = 0


SCALES = (800, 1280, 1920)
RUNGS = [*(Rung(f"scale{s}", 0) for s in SCALES), Rung("clahe1280", 0, soft=True), *(Rung(f"rot{a}", 1) for a in (270, 90, 180, 15, 345)), Rung("bin_dilate1280", 1.5, soft=True), *(Rung("crop", 2, crop=k) for k in range(1, 7)), Rung("up1920", 3), Rung("enhance", 4)]


def _reader(engine: Engine, rung: Rung):
    columns = [c.split()[0] for c in _READ.split(", ")]

    def read(batches):
        for pdf in batches:
            out = []
            for image in pdf.to_dict("records"):
                crop, began = image.pop("crop", None), time.perf_counter()
                try:
                    boxes = engine(image, rung.src, None if crop is None else [int(v) for v in crop])
                    out += [{"image_id": image["image_id"], "text": b["text"], "conf": round(float(b.get("conf", 1.0)), 3), "polygon": [[float(v) for v in p] for p in b["polygon"]], **{k: float(b.get(k, d)) for k, d in (("sx", 1.0), ("sy", 1.0), ("ox", 0.0), ("oy", 0.0))}, "seq": i, "error": None, "sec": None} for i, b in enumerate(boxes)]
                    error = None
                except Exception as e:  # one bad image doesn't end the others
                    error = None if rung.soft else repr(e)[:200]
                # one row without a box tells how the reading went
                out.append(dict.fromkeys(columns) | {"image_id": image["image_id"], "seq": -1, "error": error, "sec": time.perf_counter() - began})
            yield pd.DataFrame(out, columns=columns)

    return read


def run_ladder(images: DataFrame, engine: Engine, config: LabelConfig | None = None, max_stage: float = 4, deadline: float | None = None, seconds: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Results (image_id, the resolver's columns, stage, and sec: what its readings took) and boxes. images: image_id, width, height and what the engine wants. deadline: no rung starts after that time; images then leave with the last stage begun. seconds: what the readings of one image may take; it leaves after the reading that goes beyond, with that reading's stage."""
    spark = images.sparkSession
    images = written(images)
    boxes = spark.createDataFrame([], "image_id string, stage_ord int, box_seq int, text string, conf double, src string, box array<int>")
    spent = spark.createDataFrame([], "image_id string, sec double")
    left = written(images.select("image_id"))
    exits: list[DataFrame] = []
    crops = None
    last = 0.0
    no = F.array().cast("array<struct<text:string,src:string>>")

    def leave(ids: DataFrame, stage: float) -> None:
        nonlocal left
        exits.append(ids.select("image_id", F.lit(float(stage)).alias("stage")))
        left = written(left.join(ids.select("image_id"), "image_id", "left_anti"))

    def resolved(ids: DataFrame) -> DataFrame:
        mine = tokens_from_boxes(boxes.join(ids.select("image_id"), "image_id", "left_semi"))
        return resolve_dates(ids.select("image_id").join(mine, "image_id", "left").withColumn("items", F.coalesce("items", no)), config)

    whole = (F.col("year") != "NONE") & (F.col("month") != "NONE") & (F.col("day") != "NONE")
    filled = sum((F.col(c) != "NONE").cast("int") for c in ("year", "month", "day"))
    for ord_, rung in enumerate(RUNGS):
        if rung.stage > last:
            if last == 1.5:  # two cells are enough here
                leave(written(resolved(left).where(filled >= 2).select("image_id")), 1.5)
            out_of_time = deadline is not None and time.time() > deadline
            if max_stage < (2 if rung.stage == 2 else rung.stage) or out_of_time:
                leave(left, last)
                break
            last = rung.stage
        if not left.limit(1).count():
            break
        some = images.join(left, "image_id", "left_semi")
        if rung.src.startswith("scale"):
            some = some.where(F.lit(int(rung.src[5:])) <= 2 * F.greatest("width", "height"))
        elif rung.src == "up1920":
            some = some.join(boxes.where("src = 'scale1920'").select("image_id").distinct(), "image_id", "left_anti")
        elif rung.crop:
            if crops is None:
                base = boxes.where(F.col("src").startswith("scale") | (F.col("src") == "clahe1280"))
                crops = written(crop_boxes(base.join(images.select("image_id", "width", "height"), "image_id")))
            some = some.join(crops.where(F.col("place") == rung.crop).select("image_id", "crop"), "image_id")
        read = written(some.mapInPandas(_reader(engine, rung), _READ))
        spent = spent.unionByName(read.where("sec is not null").select("image_id", "sec"))
        failed = read.where("error is not null").select("image_id").distinct()
        new = read.where("text is not null").select("image_id", F.lit(ord_).alias("stage_ord"), F.col("seq").alias("box_seq"), "text", "conf", F.lit(rung.src).alias("src"), bounding_box(F.col("polygon"), F.col("sx"), F.col("sy"), F.col("ox"), F.col("oy")).alias("box"))
        boxes = boxes.unionByName(new)
        if failed.limit(1).count():
            leave(failed, -1)
        if rung.src != "enhance":
            leave(written(resolved(new.select("image_id").distinct().join(left, "image_id", "left_semi")).where(whole).select("image_id")), rung.stage)
        if seconds is not None and (rung.src.startswith(("scale", "rot", "bin", "up")) or rung.crop == 6):
            leave(written(spent.groupBy("image_id").agg(F.sum("sec").alias("sec")).where(F.col("sec") > seconds).join(left, "image_id", "left_semi").select("image_id")), rung.stage)
    leave(left, last)
    stages = exits[0]
    for e in exits[1:]:
        stages = stages.unionByName(e)
    stages = written(stages)
    good = stages.where("stage >= 0").select("image_id")
    done = resolved(good).unionByName(resolve_dates(stages.where("stage < 0").select("image_id", no.alias("items")), config)).drop("items")
    sec = spent.groupBy("image_id").agg(F.round(F.sum("sec"), 2).alias("sec"))
    return done.join(stages, "image_id").join(sec, "image_id", "left").withColumn("sec", F.coalesce("sec", F.lit(0.0))), boxes


def budget(images: int, workers: int = 4, seconds: float = 2100.0, spent: float = 0.0) -> float:
    """Seconds an image may take: what is left, over all images, times the workers; one at least before that."""
    return max(1.0, (seconds - spent) / max(1, images)) * workers
