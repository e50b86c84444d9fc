"""Extraction in batches that can stop and go on.

A run lives in a folder. Its plan (the batch of every paper) is written once; the
batches are worked on in a few waves, each one Spark job; a ledger lists the
batches that are whole. A wave's rows are written first and its batches are
entered after that, so what a stopped run leaves behind is never read, and a run
that starts again takes the batches that the ledger lacks, and none twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.operators.ordered import all_batches

LEDGER = "batch long, wave string, n_papers long"


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The batches of a run that are whole, with their wave and number of papers."""
    path = f"{folder}/ledger"
    return spark.read.schema(LEDGER).parquet(path) if _there(spark, path) else spark.createDataFrame([], LEDGER)


def plan(papers: DataFrame, order: list[str], folder: str, size: int) -> DataFrame:
    """The papers with their batch (from 0, ``size`` papers each, in order over all), as the run's first start laid them down."""
    spark = papers.sparkSession
    path = f"{folder}/plan"
    if not _there(spark, path):
        all_batches(papers, order, size).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run(papers: DataFrame, order: list[str], work: Callable[[DataFrame], DataFrame], folder: str, size: int = 20, waves: int = 8, stop_after: int | None = None) -> int:
    """Work on the batches that are not yet whole; gives how many waves it did.

    ``work`` maps papers with their batch to extracted rows and keeps the column
    batch. The waves, at most ``waves`` of like size, take the open batches in
    order. A failure of ``work`` ends the run with what was whole before; with
    ``stop_after`` it ends after so many waves. Papers that come after the plan was
    laid down take no part; a run over no papers has no batches.
    """
    spark = papers.sparkSession
    planned = plan(papers, order, folder, size)
    left = planned.join(ledger(spark, folder).select("batch"), "batch", "left_anti")
    ends = left.agg(F.min("batch").alias("low"), F.max("batch").alias("high")).first()
    if ends["low"] is None:
        return 0
    width = -(-(ends["high"] + 1 - ends["low"]) // waves)
    done = 0
    for low in range(ends["low"], ends["high"] + 1, width):
        if stop_after is not None and done >= stop_after:
            break
        wave = uuid.uuid4().hex
        mine = left.filter(F.col("batch").between(low, low + width - 1))
        work(mine).write.parquet(f"{folder}/rows/{wave}")
        entry = mine.groupBy("batch").agg(F.count(F.lit(1)).alias("n_papers")).select("batch", F.lit(wave).alias("wave"), "n_papers")
        entry.write.mode("append").parquet(f"{folder}/ledger")
        done += 1
    return done


def extracted(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of all whole batches; nothing before the first wave is whole."""
    waves = [r["wave"] for r in ledger(spark, folder).select("wave").distinct().collect()]  # a few for each start
    return spark.read.parquet(*(f"{folder}/rows/{w}" for w in sorted(waves))) if waves else None
