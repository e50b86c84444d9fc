"""Queries on counts, coverage, evaluation and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions.numbers import rounded
from scholium.operators import joins, metrics
from scholium.plans.registry import query
from scholium.session import table

# fixed values: rubric bands with their gaps; prices for a million tokens
ANCHORS = [(0.0, 0.2, "poor"), (0.3, 0.4, "weak"), (0.5, 0.6, "fair"), (0.7, 0.8, "good"), (0.9, 1.0, "excellent")]
PRICES = [("click", 3.0, 15.0), ("view", 0.8, 4.0), ("purchase", 15.0, 75.0)]
EXPECTED = ["src0", "src1", "src2", "absent"]

BANDS = " ".join(f"WHEN s BETWEEN {a} AND {b} THEN '{c}'" for a, b, c in ANCHORS)
NEXT = " ".join(f"WHEN s BETWEEN {a[0]} AND {a[1]} THEN '{b[2]}'" for a, b in zip(ANCHORS, ANCHORS[1:], strict=False))


@query("SELECT e.source, coalesce(n, 0) AS n, n IS NULL AS is_missing FROM (VALUES ('src0'), ('src1'), ('src2'), ('absent')) e(source) LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) c ON c.source = e.source")
def source_counts_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of each expected source, and the sources without any."""
    return metrics.counts_with_expected(table(spark, sf_dir, "documents"), "source", EXPECTED)


@query("SELECT quality * 2 + toxic + 1 AS score, count(*) AS n FROM labels GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of each score."""
    return table(spark, sf_dir, "labels").groupBy((F.col("quality") * 2 + F.col("toxic") + 1).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT source, quality IS NOT NULL AS screened, coalesce(toxic = 1, false) AS included, CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE text END AS abstract FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
a AS (SELECT count(*) AS candidates, count_if(screened) AS n_screened, round(count_if(screened AND NOT included) / count_if(screened), 3) AS rejection_rate, round(count_if(coalesce(abstract, '') = '') / count(*), 3) AS no_abstract_rate, count(DISTINCT source) AS sources FROM c),
w AS (SELECT *, CAST(rejection_rate > 0.8 AND n_screened >= 10 AS INTEGER) + CAST(no_abstract_rate > 0.5 AS INTEGER) AS warned FROM a)
SELECT * EXCLUDE (warned, n_screened, candidates), CAST(n_screened AS BIGINT) AS n_screened, candidates, greatest(0.0, 1 - 0.25 * warned)::DOUBLE AS score, CASE WHEN warned > 0 THEN 'warning' ELSE 'passed' END AS status FROM w""")
def coverage_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejection and missing abstracts of the candidate set."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = docs.select("source", F.col("quality").isNotNull().alias("screened"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("included"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("abstract"))
    return metrics.coverage_anomaly(rows)


LEVEL = "CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'strong' WHEN 'AF' THEN 'moderate' WHEN 'NF' THEN 'weak' WHEN 'NO' THEN 'preliminary' ELSE 'other' END"


@query(f"""WITH c AS (SELECT l_suppkey, count_if(s = 'strong') AS strong, count_if(s = 'moderate') AS moderate, count_if(s = 'weak') AS weak, count_if(s = 'preliminary') AS preliminary FROM (SELECT l_suppkey, {LEVEL} AS s FROM lineitem) GROUP BY 1)
SELECT l_suppkey, CAST(strong AS BIGINT) AS strong, CAST(moderate AS BIGINT) AS moderate, CAST(weak AS BIGINT) AS weak, CAST(preliminary AS BIGINT) AS preliminary,
    CASE WHEN strong + moderate + weak + preliminary = 0 THEN '' WHEN strong >= greatest(moderate, weak, preliminary) THEN 'strong' WHEN moderate >= greatest(weak, preliminary) THEN 'moderate' WHEN weak >= preliminary THEN 'weak' ELSE 'preliminary' END AS dominant FROM c""")
def strength_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence levels of each chain and the dominant one."""
    level = F.expr(LEVEL.replace("l_returnflag || l_linestatus", "concat(l_returnflag, l_linestatus)"))
    return metrics.strength_distribution(table(spark, sf_dir, "lineitem").select("l_suppkey", level.alias("s")), "l_suppkey", "s")


@query("SELECT lang, round(avg(n_chars), 4) AS mean, round(coalesce(stddev_samp(n_chars), 0), 4) AS std, round(CAST(min(n_chars) AS DOUBLE), 4) AS low, round(CAST(max(n_chars) AS DOUBLE), 4) AS high, count(*) AS n FROM documents GROUP BY lang")
def stat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and range by language."""
    return table(spark, sf_dir, "documents").withColumn("size", F.col("n_chars").cast("double")).groupBy("lang").agg(*metrics.stats("size"))


@query("""SELECT n_name, r_name, round(coalesce(avg(s_acctbal), 0), 4) AS mean, round(coalesce(stddev_samp(s_acctbal), 0), 4) AS std, round(min(s_acctbal), 4) AS low, round(max(s_acctbal), 4) AS high, count(s_acctbal) AS n
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((), (n_name), (r_name))""")
def grouped_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistics overall, by nation and by region."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    return metrics.grouped_stats(rows, "s_acctbal", "n_name", "r_name")


@query("""SELECT doc_id, round(0.25 * recall + 0.30 * (synthesis / 5) + 0.25 * (coverage / 5) + 0.20 * (writing / 5), 4) AS overall FROM (
    SELECT doc_id, CAST(quality AS DOUBLE) AS recall, CAST(doc_id % 6 AS DOUBLE) AS synthesis, CAST(doc_id % 5 AS DOUBLE) AS coverage, CAST(toxic * 4 AS DOUBLE) AS writing FROM labels)""")
def weighted_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted score of an evaluated review."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("recall"), (F.col("doc_id") % 6).cast("double").alias("synthesis"), (F.col("doc_id") % 5).cast("double").alias("coverage"), (F.col("toxic") * 4).cast("double").alias("writing"))
    return rows.select("doc_id", metrics.weighted_overall().alias("overall"))


@query("SELECT event_type, round(avg(least(5.0, greatest(1.0, value / 20))), 4) AS mean_score, count(*) AS n, sum(CAST(round(least(5.0, greatest(1.0, value / 20)) * 100) AS BIGINT)) AS points FROM events GROUP BY event_type".replace("sum(CAST", "CAST(sum(CAST").replace(" AS BIGINT)) AS points", " AS BIGINT)) AS BIGINT) AS points"))
def rubric_category_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean clamped score of each rubric category, and its points."""
    score = F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.col("value") / 20))
    return table(spark, sf_dir, "events").withColumn("s", score).groupBy("event_type").agg(F.round(F.avg("s"), 4).alias("mean_score"), F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("s") * 100).cast("long")).alias("points"))


@query("SELECT event_type, user_id % 10 AS node, grouping(event_type) AS g, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, count(*) AS calls FROM events GROUP BY ROLLUP (event_type, node)")
def token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each stage and node with subtotals."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("node"), k.alias("k"))
    return rows.rollup("event_type", "node").agg(F.grouping("event_type").cast("long").alias("g"), F.sum("k").alias("tokens"), F.count(F.lit(1)).alias("calls"))


@query("""SELECT model, tokens_in, tokens_out, round(tokens_in * coalesce(p_in, 0) / 1e6 + tokens_out * coalesce(p_out, 0) / 1e6, 4) AS cost FROM (
    SELECT event_type AS model, CAST(sum(event_id) AS BIGINT) AS tokens_in, CAST(sum(user_id) AS BIGINT) AS tokens_out FROM events GROUP BY 1)
LEFT JOIN (VALUES ('click', 3.0::DOUBLE, 15.0::DOUBLE), ('view', 0.8, 4.0), ('purchase', 15.0, 75.0)) p(m, p_in, p_out) ON m = model""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost by model; unknown models are free."""
    usage = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.sum("event_id").alias("tokens_in"), F.sum("user_id").alias("tokens_out"))
    return metrics.token_cost(usage, PRICES)


@query(f"SELECT event_id, CASE {BANDS} END AS anchor, CASE {NEXT} END AS next_anchor FROM (SELECT event_id, round(value / 100, 2) AS s FROM events)")
def rubric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubric anchor of each score; nothing in the gaps between bands."""
    scores = table(spark, sf_dir, "events").select("event_id", rounded(F.col("value") / 100, 2).alias("s"))
    return joins.in_band(scores, ANCHORS, "s").drop("s")


@query("""WITH g AS (SELECT DISTINCT o_custkey AS doc, l_partkey AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey), n AS (SELECT doc, count(*) AS generated FROM g GROUP BY 1),
r AS (SELECT l_suppkey AS ref, l_partkey AS k FROM lineitem GROUP BY ALL), m AS (SELECT ref, count(*) AS reference FROM r GROUP BY 1),
b AS (SELECT doc, ref, count(*) AS matched FROM g JOIN r USING (k) WHERE ref = doc % 10 + 1 GROUP BY ALL)
SELECT doc, round(matched / generated, 4) AS precision, round(matched / reference, 4) AS recall, round(2 * (matched / generated) * (matched / reference) / (matched / generated + matched / reference), 4) AS f1 FROM b JOIN n USING (doc) JOIN m USING (ref)""")
def citation_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of generated citations against a reference list."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    made = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select(F.col("o_custkey").alias("doc"), (F.col("o_custkey") % 10 + 1).alias("ref"), F.col("l_partkey").alias("k")).distinct()
    wanted = lines.select(F.col("l_suppkey").alias("ref"), F.col("l_partkey").alias("k")).distinct().withColumn("hit", F.lit(1))
    sizes = wanted.groupBy("ref").agg(F.count(F.lit(1)).alias("reference"))
    both = made.join(wanted, ["ref", "k"], "left").groupBy("doc", "ref").agg(F.count(F.lit(1)).alias("generated"), F.count("hit").alias("matched")).filter("matched > 0").join(sizes, "ref")
    return both.select("doc", *metrics.precision_recall(F.col("matched"), F.col("generated"), F.col("reference")))


@query("SELECT confidence, count(*) AS n FROM (SELECT CASE WHEN quality IS NULL THEN 'none' WHEN quality = 1 AND toxic = 0 THEN 'high' WHEN quality = 1 THEN 'medium' ELSE 'low' END AS confidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1")
def resolution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of each confidence."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    confidence = F.when(F.col("quality").isNull(), "none").when((F.col("quality") == 1) & (F.col("toxic") == 0), "high").when(F.col("quality") == 1, "medium").otherwise("low")
    return docs.groupBy(confidence.alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_partkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS themes, count(*) AS n FROM lineitem GROUP BY 1")
def theme_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers to themes, from themes to papers, repeats kept."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("l_suppkey")), lambda x: x.cast("string")), ",")
    return pairs.groupBy("l_partkey").agg(joined.alias("themes"), F.count(F.lit(1)).alias("n"))


@query("SELECT 'documents' AS relation, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'events', count(*) FROM events")
def relation_cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each relation of a snapshot."""
    found = None
    for name in ("documents", "labels", "pages", "conversations", "events"):
        part = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).withColumn("relation", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


@query("SELECT source, count(*) AS papers, CAST(count_if(length(text) > 3000) AS BIGINT) AS with_full_text, round(100.0 * count_if(length(text) > 3000) / count(*), 1) AS pct FROM documents GROUP BY source")
def full_text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with a full text, by source."""
    full = F.count_if(F.length("text") > 3000)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("papers"), full.alias("with_full_text"), F.round(100.0 * full / F.count(F.lit(1)), 1).alias("pct"))
