"""Session factory and table loading shared by queries, tests and the bench."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings that the plans rely on (UTC, AQE, Arrow)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table ``name`` below ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that the cluster shares for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder serves for both ``checkpoint()`` and written tables, on a
    single machine only: on a cluster no local folder is shared, so that is an
    error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-scholium-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/scholium-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with files that every executor can read, so a lost
    executor costs one task and not the steps before.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def reread(written: list[DataFrame]) -> DataFrame:
    """The rows of tables of one schema that ``materialise`` wrote, by one scan however many they are."""
    first = written[0]
    return first.sparkSession.read.schema(first.schema).parquet(*(w.written_at for w in written))


def release(*written: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once all that reads them is written."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
