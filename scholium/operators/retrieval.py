"""Full texts by the first strategy that succeeds, and reports of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.sources.records import first_success


def cascade(rows: DataFrame, **attempts: Column) -> DataFrame:
    """Adds full_text and strategy: the first usable attempt and its name, both null where none is."""
    text, name = first_success(**attempts)
    return rows.withColumns({"full_text": text, "strategy": name})


def text_coverage(rows: DataFrame, by: str, strategies: list[str]) -> DataFrame:
    """Papers of each group with a full text, an abstract only or a title only, and details by strategy.

    rows: abstract, full_text, strategy; a null abstract counts as an empty one.
    """
    full = F.col("strategy").isNotNull()
    told = F.coalesce(F.col("abstract"), F.lit("")) != ""
    each = {f"_{s}": F.count_if(F.col("strategy") == s) for s in sorted(strategies)}
    found = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(full).alias("full_text"), F.count_if(~full & told).alias("abstract_only"), F.count_if(~full & ~told).alias("title_only"),
        *(n.alias(k) for k, n in each.items()),
    )
    details = F.concat_ws(", ", *(F.when(F.col(k) > 0, F.concat(F.lit(k[1:] + ": "), F.col(k).cast("string"))) for k in each))
    return found.withColumns({"pct_full_text": F.round(100.0 * F.col("full_text") / F.col("total"), 1), "details": details}).drop(*each)


def injection_report(lines: DataFrame, cached: DataFrame, resolved: DataFrame, review: str, pos: str, first: int = 20) -> DataFrame:
    """Resolved and failed references of each bibliography, by confidence, with the first failed lines in order.

    lines: review, pos, raw; cached and resolved: raw (each once) and
    confidence. What the cache holds is not resolved anew. A null line counts as empty.
    """
    whole = lines.withColumn("raw", F.coalesce("raw", F.lit("")))
    found = whole.join(cached.select("raw", F.col("confidence").alias("_cached")), "raw", "left").join(resolved.select("raw", F.col("confidence").alias("_resolved")), "raw", "left")
    found = found.withColumn("_by", F.coalesce("_cached", "_resolved"))
    levels = ("high", "medium", "low")
    counts = found.groupBy(review).agg(F.count(F.lit(1)).alias("total_extracted"), F.count("_by").alias("resolved_count"), *(F.count_if(F.col("_by") == c).alias(c) for c in levels))
    place = F.row_number().over(Window.partitionBy(review).orderBy(pos, "raw"))
    head = found.filter("_by IS NULL").withColumn("_n", place).filter(F.col("_n") <= first)
    failed = head.groupBy(review).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "raw"))), lambda x: x["raw"]).alias("failed_references"))
    report = counts.withColumn("failed_count", F.col("total_extracted") - F.col("resolved_count")).join(failed, review, "left")
    return report.withColumn("failed_references", F.coalesce("failed_references", F.array().cast("array<string>")))
