"""Sections of plain-text papers, and truncation that knows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: a heading line, and the marks left by cuts
HEADING = r"^(?:(?:\d+(?:\.\d+)*\.?[ \t]+)|(?:[IVXivx]+\.?[ \t]+))?([A-Z][A-Za-z \t,&\-/]+)[ \t]*$"
CUT, CUT_INTRO, CUT_METHODS = "\n\n[...truncated middle section...]\n\n", "\n[...introduction truncated...]\n", "\n[...methods truncated...]\n"
DROPPED = ("references", "acknowledgment", "acknowledgement", "supplementary", "supporting information", "funding", "author contributions", "competing interests", "conflict of interest", "data availability")


def parse_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section (0 before the first heading), name and body, heading included.

    A heading is a line of at most 80 characters; a text with fewer than two
    has the one section 0.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("no", "line"))
    lines = lines.withColumn("heading", F.col("line").rlike(HEADING) & (F.length(F.trim("line")) <= 80))
    order = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("total", F.count_if("heading").over(Window.partitionBy(key))).withColumn("section", F.when(F.col("total") < 2, 0).otherwise(F.count_if("heading").over(order)))
    parts = F.array_sort(F.collect_list(F.struct("no", "line")))
    name = F.trim(F.regexp_extract(F.min_by("line", "no"), HEADING, 1))
    return placed.groupBy(key, "section").agg(name.alias("name"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("body"), F.min("no").alias("no")).withColumn("name", F.when(F.col("section") > 0, F.col("name"))).drop("no")


def truncate(docs: DataFrame, most: int, intro: int = 3000, methods: int = 2000, dropped: tuple[str, ...] = DROPPED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text without dropped sections, introduction and methods cut, and the whole cut in the middle if it is still too long."""
    sections = parse_sections(docs, key, text)
    low = F.trim(F.lower("name"))
    drop = F.exists(F.array(*map(F.lit, dropped)), lambda p: F.contains(low, p) | F.contains(p, low))
    named = F.col("section") > 0
    is_intro, is_methods = F.contains(low, F.lit("introduction")), F.contains(low, F.lit("method"))
    body = F.when(is_intro & F.lit(intro > 0) & (F.length("body") > intro), F.concat(F.substring("body", 1, intro), F.lit(CUT_INTRO))).otherwise(F.col("body"))
    body = F.when(is_methods & (F.length(body) > methods), F.concat(F.substring(body, 1, methods), F.lit(CUT_METHODS))).otherwise(body)
    away = named & (drop | (is_methods & F.lit(methods == 0)))
    kept = F.when(~F.coalesce(away, F.lit(False)) & (named | (F.trim("body") != "")), F.struct("section", F.when(named, body).otherwise(F.col("body")).alias("body")))
    joined = sections.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda p: p["body"]), "\n").alias("kept"))
    head = most // 3
    return joined.select(key, F.when(F.length("kept") <= most, F.col("kept")).otherwise(F.concat(F.substring("kept", 1, head), F.lit(CUT), F.substring("kept", head - most, most - head))).alias(text))
