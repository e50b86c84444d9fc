"""What a run leaves behind: snapshots of its tables, summaries, usage files and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.operators.metrics import token_cost


def save(tables: dict[str, DataFrame], folder: str, node: str, stamp: str) -> str:
    """Write the tables, without their full texts, below folder/stamp_node, then a pointer to it; gives its path.

    The pointer is written last, so it never names a snapshot that is not whole.
    """
    path = f"{folder}/{stamp}_{node}"
    for name, rows in tables.items():
        rows.drop("full_text").write.parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(path, name) for name in tables], "path string, name string").coalesce(1).write.mode("overwrite").json(f"{folder}/latest")
    return path


def latest(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the latest snapshot."""
    listed = spark.read.schema("path string, name string").json(f"{folder}/latest").collect()  # one row for each table
    return {r["name"]: spark.read.parquet(f"{r['path']}/{r['name']}") for r in listed}


def usage_costs(spark: SparkSession, files: str, prices: list[tuple[str, float, float]]) -> DataFrame:
    """label, model, tokens and cost of token-usage JSON files; the label is the file's folder, no model is 'unknown'."""
    read = spark.read.schema("model string, input_tokens long, output_tokens long").option("multiLine", True).json(files)
    label = F.element_at(F.split(F.url_decode(F.col("_metadata.file_path")), "/"), -2)
    rows = read.select(label.alias("label"), F.coalesce("model", F.lit("unknown")).alias("model"), F.coalesce("input_tokens", F.lit(0)).alias("tokens_in"), F.coalesce("output_tokens", F.lit(0)).alias("tokens_out"))
    return token_cost(rows, prices)


def search_summary(papers: DataFrame, summary: str) -> DataFrame:
    """The lines of a search node's summary: the count of candidates, and of each source in order."""
    counts = papers.groupBy("source_database").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    head = total.select(F.lit("").alias("at"), F.concat(F.lit(f"# search\n\n**Summary**: {summary}\n\n- Candidates: "), F.col("n").cast("string")).alias("line"))
    each = counts.select(F.col("source_database").alias("at"), F.concat(F.lit("  - "), "source_database", F.lit(": "), F.col("n").cast("string")).alias("line"))
    return head.unionByName(each).orderBy("at").select("line")


def save_reports(reports: DataFrame, folder: str) -> None:
    """Evaluation rows as JSON lines."""
    reports.write.mode("overwrite").json(folder)


def save_progress(nodes: DataFrame, folder: str, topic: str, started: str, current: str | None = None) -> None:
    """One JSON record of a run: its topic, start, current node, and its nodes (name, status, seconds) by name.

    A run has a few nodes, so they go into one record.
    """
    listed = nodes.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("status", "seconds"))))).alias("nodes"))
    listed.select(F.lit(topic).alias("topic"), F.lit(started).alias("started"), F.lit(current).cast("string").alias("current_node"), "nodes").write.mode("overwrite").json(folder)
