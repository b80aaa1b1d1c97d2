"""Running scores: a run log read as a stream, its score brought up to date with every batch that arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.evaluate import score_of, score_parts
from ..sources.files import RUN_LOG


def running_score(spark: SparkSession, folder: str, gold: DataFrame, checkpoint: str, sink: str) -> StreamingQuery:
    """Starts a query that writes, for every batch of new log files, the score of all rows up to it to sink/scores/batch=N. Each batch is read once: its parts stay in sink/parts/batch=N and are added up. A batch that is tried again writes the same folders again."""
    rows = spark.readStream.schema(RUN_LOG).option("mode", "DROPMALFORMED").json(folder)

    def update(batch: DataFrame, number: int) -> None:
        own = score_parts(batch, gold)
        own.write.mode("overwrite").parquet(f"{sink}/parts/batch={number}")
        kind = StructType([*own.schema.fields, StructField("batch", LongType())])
        so_far = batch.sparkSession.read.schema(kind).parquet(f"{sink}/parts").where(F.col("batch") <= number)
        score_of(so_far).coalesce(1).write.mode("overwrite").parquet(f"{sink}/scores/batch={number}")

    return rows.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
