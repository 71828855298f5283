"""Running activity counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engram.streaming.ingest import ONCE


def stream_daily_activity(
    arriving: DataFrame, path: str, checkpoint: str, delay: str = "2 days", trigger: dict | None = None
) -> StreamingQuery:
    """Count arrivals per day. Every batch replaces the folders of the days it changed, so the
    table has one small file a day however many batches there were, and a batch that runs again
    changes nothing; rows later than the watermark are dropped and finished days leave the state."""
    daily = (
        arriving.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("memories"))
        .select(F.to_date("w.start").alias("day"), "memories")
    )

    def write(batch: DataFrame, _: int) -> None:
        days = batch.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        days.partitionBy("day").parquet(path)

    return (
        daily.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def current_activity(spark: SparkSession, path: str) -> DataFrame:
    """The latest count of every day."""
    return spark.read.schema("memories long, day date").parquet(path).select("day", "memories")
