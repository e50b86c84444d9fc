"""Queries on full texts by cascade and on injected bibliographies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.operators import retrieval
from scholium.plans.registry import query
from scholium.session import table

STRATEGIES = ["publisher", "open_access", "repository"]

FOUND = """SELECT doc_id, source, CASE WHEN doc_id % 5 <> 0 THEN md5(text) END AS abstract, left(CASE WHEN doc_id % 3 = 0 AND length(text) > 100 THEN text WHEN length(html) > 100 AND doc_id % 2 = 0 THEN html WHEN doc_id % 7 = 0 AND length(text) > 100 THEN text END, 200000) AS full_text,
    CASE WHEN doc_id % 3 = 0 AND length(text) > 100 THEN 'publisher' WHEN length(html) > 100 AND doc_id % 2 = 0 THEN 'open_access' WHEN doc_id % 7 = 0 AND length(text) > 100 THEN 'repository' END AS strategy FROM documents LEFT JOIN pages ON page_id = doc_id"""


def attempted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what three strategies give for their full text."""
    d = F.col("doc_id")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    docs = table(spark, sf_dir, "documents").join(pages, "doc_id", "left")
    rows = docs.select("doc_id", "source", "text", "html", F.when(d % 5 != 0, F.md5("text")).alias("abstract"))
    return retrieval.cascade(rows, publisher=F.when(d % 3 == 0, F.col("text")), open_access=F.when(d % 2 == 0, F.col("html")), repository=F.when(d % 7 == 0, F.col("text")))


@query(f"SELECT doc_id, strategy, md5(full_text) AS full_text FROM ({FOUND})")
def text_source_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full text of each paper from the first strategy that has a usable one."""
    return attempted(spark, sf_dir).select("doc_id", "strategy", F.md5("full_text").alias("full_text"))


@query(f"""WITH f AS ({FOUND}), n AS (SELECT source, strategy, count(*) AS n FROM f WHERE strategy IS NOT NULL GROUP BY ALL)
SELECT source, count(*) AS total, count(strategy) AS full_text, CAST(count_if(strategy IS NULL AND abstract IS NOT NULL) AS BIGINT) AS abstract_only, CAST(count_if(strategy IS NULL AND abstract IS NULL) AS BIGINT) AS title_only, round(100.0 * count(strategy) / count(*), 1) AS pct_full_text,
    coalesce((SELECT string_agg(strategy || ': ' || n, ', ' ORDER BY strategy) FROM n WHERE n.source = f.source), '') AS details FROM f GROUP BY source""")
def text_retrieval_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a round of full-text retrieval found, by source."""
    return retrieval.text_coverage(attempted(spark, sf_dir), "source", STRATEGIES)


@query("""WITH l AS (SELECT l_suppkey AS review, l_orderkey, l_linenumber, l_partkey, 'Doe J. Part ' || l_partkey || '.' AS raw FROM lineitem),
f AS (SELECT l.*, CASE WHEN p_partkey % 4 = 0 THEN 'low' WHEN p_size > 30 THEN 'high' WHEN p_size % 2 = 0 THEN 'medium' END AS lvl FROM l LEFT JOIN part ON p_partkey = l_partkey),
x AS (SELECT review, raw, row_number() OVER (PARTITION BY review ORDER BY l_orderkey, l_linenumber, raw) AS n FROM f WHERE lvl IS NULL)
SELECT review, count(*) AS total_extracted, count(lvl) AS resolved_count, CAST(count_if(lvl = 'high') AS BIGINT) AS high, CAST(count_if(lvl = 'medium') AS BIGINT) AS medium, CAST(count_if(lvl = 'low') AS BIGINT) AS low, count(*) - count(lvl) AS failed_count,
    coalesce((SELECT string_agg(raw, '|' ORDER BY n) FROM x WHERE x.review = f.review AND n <= 20), '') AS failed_references FROM f GROUP BY review""")
def bibliography_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on bibliographies whose lines a cache or a search resolves."""
    raw = lambda c: F.concat(F.lit("Doe J. Part "), F.col(c).cast("string"), F.lit(".")).alias("raw")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("review"), F.struct("l_orderkey", "l_linenumber").alias("pos"), raw("l_partkey"))
    part = table(spark, sf_dir, "part")
    cached = part.filter("p_partkey % 4 = 0").select(raw("p_partkey"), F.lit("low").alias("confidence"))
    level = F.when(F.col("p_size") > 30, "high").when(F.col("p_size") % 2 == 0, "medium")
    resolved = part.select(raw("p_partkey"), level.alias("confidence")).filter("confidence IS NOT NULL")
    report = retrieval.injection_report(lines, cached, resolved, "review", "pos")
    return report.withColumn("failed_references", F.array_join("failed_references", "|"))
