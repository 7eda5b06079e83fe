"""Repair of newly landed flights as a stream. A flight comes whole in one file, so batches need no state."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flightloom.operators.tracks import repair
from flightloom.sources.scans import TRACK, micros, utc


def repair_landed(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Repairs what has landed since the last run and ends; a batch run again overwrites its own output."""
    stream = utc(spark).readStream.schema(TRACK).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def write(batch, number: int) -> None:
        rows = batch.withColumn("us", micros(batch, "timestamp")).drop("timestamp")
        repair(rows).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
