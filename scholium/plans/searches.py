"""Queries on recorded searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.operators import screening
from scholium.plans.corpus import PAPERS, papers
from scholium.plans.registry import query
from scholium.session import shared_folder, table
from scholium.sources import recorded, records


def record_papers(spark: SparkSession, sf_dir: str) -> str:
    """The papers as recorded responses: a query for each source, the most cited first; gives the folder."""
    found = papers(spark, sf_dir)
    folder = shared_folder(spark)
    record = F.to_json(F.struct(F.lit(1).alias("v"), "title", "doi", "year", "citation_count"))
    recorded.save(found.select(F.col("source_database").alias("query"), F.col("doc_id").cast("string").alias("id"), record.alias("json"), "citation_count", "doc_id"), folder, [F.desc_nulls_last("citation_count"), "doc_id"])
    return folder


RECORDED = f"{PAPERS}, recorded AS (SELECT source_database AS query, CAST(row_number() OVER (PARTITION BY source_database ORDER BY citation_count DESC NULLS LAST, doc_id) AS INTEGER) AS rank, doc_id, title, doi, year FROM papers)"


def shaped(rows: DataFrame) -> DataFrame:
    paper = F.from_json("json", "title string, doi string, year int")
    return rows.withColumn("paper", paper).select("query", "rank", F.col("id").cast("long").alias("doc_id"), F.md5("paper.title").alias("title"), "paper.doi", F.col("paper.year").cast("long").alias("year"))


@query(f"WITH {RECORDED} SELECT query, rank, doc_id, md5(title) AS title, doi, year FROM recorded WHERE rank <= (SELECT greatest(200 // count(DISTINCT source_database), 20) FROM papers)")
def recorded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded fetch from every query of a recorded search."""
    return shaped(recorded.search(spark, record_papers(spark, sf_dir), max_results=200))


@query(f"WITH {RECORDED} SELECT query, rank, doc_id, md5(title) AS title, doi, year FROM recorded WHERE doc_id = (SELECT max(doc_id) // 2 FROM documents)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of one paper by its id."""
    key = papers(spark, sf_dir).agg(F.floor(F.max("doc_id") / 2).alias("k")).first()["k"]
    return shaped(recorded.details(spark, record_papers(spark, sf_dir), str(key)))


@query(f"WITH {RECORDED} SELECT query, rank, doc_id, md5(title) AS title, doi, year FROM recorded WHERE query IN ('src0', 'src1') ORDER BY query, rank LIMIT 30")
def search_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty results of two queries, one after the other."""
    found = recorded.search(spark, record_papers(spark, sf_dir), queries=["src0", "src1"])
    return shaped(found.orderBy("query", "rank").limit(30))


@query(f"""WITH {PAPERS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source_database ORDER BY citation_count DESC NULLS LAST, doc_id) AS rank FROM papers WHERE source_database IN ('src0', 'src1', 'src2')),
dated AS (SELECT * REPLACE (row_number() OVER (ORDER BY source_database, rank) - 1 AS pos) FROM ranked WHERE year >= 2005 AND year <= 2020),
found AS (SELECT * REPLACE (regexp_replace(lower(nullif(trim(doi), '')), '^https?://(dx\\.)?doi\\.org/', '') AS doi), trim(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS title_key FROM dated)
SELECT doi AS merge_key, min(pos) AS first_pos, arg_min(source_database, pos) AS source_database, arg_min(year, pos) AS year, count(*) AS n_merged FROM found WHERE coalesce(doi, '') <> '' GROUP BY 1
UNION ALL SELECT title_key, min(pos), arg_min(source_database, pos), arg_min(year, pos), count(*) FROM found WHERE coalesce(doi, '') = '' AND title_key NOT IN (SELECT title_key FROM found WHERE coalesce(doi, '') <> '') GROUP BY 1""")
def multi_source_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of three recorded sources within some years, merged in the order of the sources."""
    folder = record_papers(spark, sf_dir)
    paper = F.from_json("json", "title string, doi string, year int, citation_count int")

    def source(name: str) -> DataFrame:
        return recorded.search(spark, folder, queries=[name]).withColumn("p", paper).select("rank", "p.*", F.col("query").alias("source_database"))

    found = screening.multi_source_search([source(f"src{k}") for k in range(3)], 2005, 2020)
    return found.select("merge_key", "first_pos", "source_database", F.col("year").cast("long").alias("year"), "n_merged")


@query(f"""WITH {PAPERS} SELECT source_database, CAST(row_number() OVER (PARTITION BY source_database ORDER BY coalesce(citation_count, 0) DESC, pos) AS INTEGER) AS seed, doc_id FROM papers WHERE doc_id % 4 <> 0 QUALIFY seed <= 10""")
def snowball_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most cited papers of each source that a snowball can start from."""
    found = papers(spark, sf_dir).withColumn("s2_id", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id").cast("string")))
    return screening.top_cited(found, ["source_database"]).select("source_database", "seed", "doc_id")


@query("SELECT user_id FROM (SELECT user_id, min((ts, event_id)) AS t FROM events GROUP BY 1) ORDER BY t, user_id LIMIT 25")
def first_seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty-five different ids, in the order of their appearance."""
    return screening.first_seen(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 25)


@query("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents), d AS (SELECT doc_id // 20 AS batch, doc_id % 23 AS index, quality * 4 + toxic * 3 - CAST(doc_id % 2 AS INTEGER) AS score, doc_id AS pos FROM labels),
s AS (SELECT batch, index, arg_max(score, pos) AS score FROM d WHERE index < 20 GROUP BY ALL), m AS (SELECT doc_id, place // 20 AS batch, place % 20 AS index, least(5, greatest(1, score)) AS score FROM p JOIN s ON s.batch = place // 20 AND s.index = place % 20)
SELECT doc_id, CAST(batch AS BIGINT) AS batch, index, score, CASE WHEN score = 3 THEN 'small' ELSE 'large' END AS model FROM m""")
def decided_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with the decision of their batch and index, indexes out of range ignored, and the model that the score calls for."""
    d = F.col("doc_id")
    decisions = table(spark, sf_dir, "labels").select(F.floor(d / 20).alias("batch"), (d % 23).alias("index"), (F.col("quality") * 4 + F.col("toxic") * 3 - (d % 2).cast("int")).alias("score"), d.alias("pos"))
    found = screening.decided(table(spark, sf_dir, "documents").select("doc_id"), decisions, ["doc_id"])
    return found.select("doc_id", "batch", "index", "score", screening.model_for(F.col("score")).alias("model"))


@query("SELECT CAST(sum(k) FILTER (event_id % 3 < 2) AS BIGINT) AS input_tokens, CAST(sum(user_id) FILTER (event_id % 3 <> 1) AS BIGINT) AS output_tokens FROM (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input and output tokens of a whole audit log, by its maps."""
    k, e = F.get_json_object("props", "$.k").cast("long"), F.col("event_id") % 3
    usage = F.when(e == 0, F.create_map(F.lit("input_tokens"), k, F.lit("output_tokens"), F.col("user_id"))).when(e == 1, F.create_map(F.lit("input_tokens"), k, F.lit("cache_read"), F.col("user_id"))).otherwise(F.create_map(F.lit("output_tokens"), F.col("user_id")))
    return screening.token_totals(table(spark, sf_dir, "events").select(usage.alias("token_usage")))


@query(f"WITH {RECORDED} SELECT rank, md5(title) AS title, CAST(year AS VARCHAR) AS year, doi, 6 AS fields FROM recorded WHERE query = 'src0' AND rank <= 20")
def tool_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search tool answers for one source, without dedup: a JSON record of six fields for each result."""
    found = recorded.search(spark, record_papers(spark, sf_dir), max_results=20, queries=["src0"])
    paper = F.from_json("json", "title string, doi string, year int")
    rows = found.select("rank", F.col("query").alias("source_database"), paper.alias("p")).select("rank", "source_database", "p.*")
    said = rows.select("rank", records.shown(rows).alias("record"))
    field = lambda name: F.get_json_object("record", f"$.{name}")
    return said.select("rank", F.md5(field("title")).alias("title"), field("year").alias("year"), field("doi").alias("doi"), F.size(F.json_object_keys("record")).alias("fields"))


SCREENED = f"""{PAPERS}, p AS (SELECT doc_id, abstract, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM papers), s AS (SELECT doc_id // 20 AS batch, doc_id % 20 AS index, arg_max(quality * 3 + toxic - CAST(doc_id % 3 AS INTEGER), doc_id) AS score FROM labels GROUP BY ALL),
d AS (SELECT doc_id, least(5, greatest(1, score)) AS score FROM p JOIN s ON s.batch = place // 20 AND s.index = place % 20), again AS (SELECT doc_id, least(5, greatest(1, CAST(doc_id % 5 AS INTEGER))) AS score FROM labels),
chosen AS (SELECT doc_id, score, false AS promoted FROM d WHERE score >= 3 UNION ALL SELECT d.doc_id, a.score, true FROM d JOIN again a ON a.doc_id = d.doc_id AND d.score = 2 AND a.score >= 3)"""


def screening_stage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = F.col("doc_id")
    labels = table(spark, sf_dir, "labels")
    decisions = labels.select(F.floor(d / 20).alias("batch"), (d % 20).alias("index"), (F.col("quality") * 3 + F.col("toxic") - (d % 3).cast("int")).alias("score"), d.alias("pos"))
    second = labels.select("doc_id", (d % 5).cast("int").alias("score"))
    return screening.screen(papers(spark, sf_dir).select("doc_id", "abstract"), decisions, second, ["doc_id"])


@query(f"WITH {SCREENED} SELECT doc_id, score, promoted FROM chosen")
def screened_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that screening lets in, with those that a second look promotes."""
    return screening_stage(spark, sf_dir)[0].select("doc_id", "score", "promoted")


@query(f"""WITH {SCREENED}, n AS (SELECT count(*) AS candidates, count_if(coalesce(abstract, '') = '') AS no_abstract FROM p), i AS (SELECT count(*) AS included, count_if(promoted) AS promoted FROM chosen)
SELECT *, round(1.0::DOUBLE - included / candidates, 4) AS rejection_rate, CASE WHEN 1 - included / candidates > 0.8 OR included < 10 OR no_abstract / candidates > 0.5 THEN 'warning' ELSE 'passed' END AS status FROM n, i""")
def screening_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the screening of all papers went."""
    return screening_stage(spark, sf_dir)[1]
