"""The audit log as a stream (beyond the reference, which has batch only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def audit_stream(spark: SparkSession, events: DataFrame, path: str) -> DataFrame:
    """A stream over the files at ``path`` with the columns of ``events`` and ts as a timestamp."""
    return spark.readStream.schema(events.schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def token_windows(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Calls and tokens of each type in windows of event time."""
    tokens = F.get_json_object("props", "$.k").cast("long")
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens).alias("tokens")).select(F.col("window.start").alias("start"), "event_type", "calls", "tokens")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events without repeats of their keys within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, restartable from its checkpoint, and read what it wrote."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")
