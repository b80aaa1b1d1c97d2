"""Intermediate tables in the shared folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a folder of our own on a local master, as in tests; a cluster's executors share none, so that there it must be named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "shelfdate-checkpoints"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, parts: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and a lost executor costs nothing. parts: how many tasks make it at most."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    (df if parts is None else df.coalesce(parts)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that written() gave and that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def cleaned(spark: SparkSession, rounds: int = 1) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps whose results are written and whose plans are no longer held. The first round misses the shuffles of the step written last, a second one finds them."""
    for _ in range(rounds):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
