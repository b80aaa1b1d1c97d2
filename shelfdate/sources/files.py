"""Sources and sinks: images, boxes, labels, run logs, summaries and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import clean_cell, zero_fill

BOX = "struct<text:string,conf:double,src:string,box:array<int>>"
GOLD = "image_id string, year string, month string, day string, final_date string"
RUN_LOG = f"image_id string, year string, month string, day string, final_date string, rule string, stage double, sec double, boxes array<{BOX}>"
SUMMARY = "n long, full long, full_pct double, cells_pct double, false_positive long, miss_all_none long, sec_mean double, sec_median double, sec_max double, min_4core_500 double, stages map<string,long>, name string, cfg struct<thresh:double,box:double,unclip:double>, budget double, wall_sec long"


def image_id(path: Column) -> Column:
    """The file's name without its folder and extension. Files that differ in those alone share an id."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_images(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """path, length, content and image_id of the image files in a folder, not below it. limit: the first so many by path."""
    found = spark.read.format("binaryFile").load(folder).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*fixed.IMAGE_TYPES)).select("path", "length", "content", image_id(F.col("path")).alias("image_id"))
    return found if limit is None else found.orderBy("path").limit(limit)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a CSV file with a header; ids are zero-filled."""
    rows = spark.read.schema(GOLD).option("header", True).option("encoding", "UTF-8").option("enforceSchema", True).csv(path)
    return rows.withColumn("image_id", zero_fill(F.regexp_replace("image_id", "^﻿", "")))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines run log; lines that don't parse are left out."""
    return spark.read.schema(RUN_LOG).option("mode", "DROPMALFORMED").json(path)


def last_runs(log: DataFrame, order: str) -> DataFrame:
    """Of every image the last row of a log by that column."""
    return log.groupBy("image_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "image_id"]), order).alias("r")).select("image_id", "r.*")


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """All *.summary.json of a folder but smoke runs, with the run's name from the file's."""
    rows = spark.read.schema(SUMMARY).option("multiLine", True).option("pathGlobFilter", "*.summary.json").json(folder)
    return rows.withColumn("name", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.summary\.json$", 1)).where(~F.col("name").contains("smoke"))


def predictions(resolved: DataFrame) -> DataFrame:
    """The five columns of a prediction, all strings, missing cells NONE."""
    return resolved.select(*[clean_cell(F.col(c)).alias(c) for c in fixed.PREDICTION])


def write_predictions(resolved: DataFrame, folder: str, order: str | None = None) -> None:
    """Predictions as CSV with a header; order: a column to sort by, which makes it one file."""
    rows = resolved if order is None else resolved.orderBy(order).coalesce(1)
    predictions(rows).write.mode("overwrite").option("header", True).csv(folder)


def append_run_log(rows: DataFrame, folder: str) -> None:
    """Adds rows to a run log of JSON lines."""
    rows.write.mode("append").json(folder)


def write_summary(summary: DataFrame, folder: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(folder)
