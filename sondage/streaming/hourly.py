"""Counts of answers by hour as a stream, with a watermark for late rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.sources.stored import shared_dir


def hourly_counts(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tumbling windows of one hour. In append and update mode the state of an hour goes once the watermark has passed it; complete mode keeps all."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return counted.select(F.col("window.start").alias("hour"), F.col("event_type").alias("answer"), "n", "mean")


def run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read what is there as a stream, then stop. Every batch replaces the table of a fresh folder by the counts of all hours so far (complete mode)."""
    base = f"{shared_dir(spark)}/sondage/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    stream = hourly_counts(rows).writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(store)
    stream.start().awaitTermination()
    return spark.read.parquet(f"{base}/out").withColumn("hour", F.col("hour").cast("timestamp_ntz"))
