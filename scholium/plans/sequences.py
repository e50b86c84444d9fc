"""Queries on ordered rows, top-k and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.operators import joins, ordered, trees, validation
from scholium.plans.registry import query
from scholium.session import table


@query("""WITH s AS (SELECT conv_id, turn, round(length(text) % 100 / 100.0, 2)::DOUBLE AS score FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, score - lag(score) OVER (PARTITION BY conv_id ORDER BY turn) AS gain FROM s),
w AS (SELECT *, CASE WHEN n >= 4 THEN 'max_iterations' WHEN score >= 0.8 THEN 'threshold' WHEN n >= 2 AND gain < 0.02 THEN 'converged' END AS reason FROM o)
SELECT conv_id, turn AS stop_cycle, CAST(n AS INTEGER) AS iterations, score, reason FROM w WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""")
def convergence_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the revision of each target stops."""
    scores = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(F.length("text") % 100 / 100.0, 2).alias("score"))
    return ordered.convergence(scores, "conv_id", "turn", "score", 0.8, 4, 0.02)


@query("""SELECT user_id, event_id, running FROM (SELECT user_id, event_id, ts, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events)
WHERE running > 300 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def budget_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First call of each user over the token budget."""
    usage = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return ordered.budget_crossing(usage, "user_id", ["ts", "event_id"], "k", 300).select("user_id", "event_id", "running")


CALLS = "calls AS (SELECT event_id, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls of a run, whoever made them."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"WITH {CALLS} SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place, CAST(sum(k) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_k FROM calls")
def token_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and running total of every call of the run."""
    return ordered.placed(calls(spark, sf_dir), ["ts", "event_id"], ("k",)).select("event_id", "place", "running_k")


@query(f"""WITH {CALLS}, r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place, CAST(sum(k) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM calls)
SELECT * FROM r WHERE running > 100000 ORDER BY place LIMIT 1""")
def budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call at which the run as a whole is over its token budget."""
    return ordered.first_over(calls(spark, sf_dir), ["ts", "event_id"], "k", 100_000).select("event_id", "place", "running")


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 20 AS BIGINT) AS batch FROM events")
def run_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of twenty over all events, whoever they belong to."""
    return ordered.all_batches(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], 20).select("event_id", "batch")


@query("""WITH p AS (SELECT l_suppkey AS theme, year(o_orderdate) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey), e AS (SELECT theme, min(y) AS a, max(y) AS b, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 4 AND max(y) - min(y) >= 3)
SELECT theme, CAST(a AS INTEGER) AS first_year, CAST(b AS INTEGER) AS last_year, n, CAST(count_if(y <= a + (b - a) // 2) AS BIGINT) AS n_early, CAST(count_if(y > a + (b - a) // 2) AS BIGINT) AS n_late FROM p JOIN e USING (theme) GROUP BY theme, a, b, n""")
def temporal_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early and late papers of each theme."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("l_suppkey").alias("theme"), F.year("o_orderdate").alias("year"))
    return ordered.temporal_split(rows, "theme")


def marked_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section texts with a marker for each line of an order."""
    lines = table(spark, sf_dir, "lineitem")
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("Shown [@"), p["l_partkey"].cast("string"), F.lit("]."))), " ")
    return lines.groupBy("l_orderkey").agg(text.alias("text"))


SECTIONS = "sections AS (SELECT l_orderkey, string_agg('Shown [@' || l_partkey || '].', ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS text FROM lineitem GROUP BY 1)"
MARKS = r"marks AS (SELECT l_orderkey, unnest(m) AS cited, generate_subscripts(m, 1) - 1 AS place FROM (SELECT l_orderkey, regexp_extract_all(text, '\[@([^\]]+)\]', 1) AS m FROM sections))"


@query(f"""WITH {SECTIONS}, {MARKS}
SELECT l_orderkey, cited, CAST(first_at AS INTEGER) AS first_at, mentions, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY first_at) AS INTEGER) AS number FROM (SELECT l_orderkey, cited, min(place) AS first_at, count(*) AS mentions FROM marks GROUP BY ALL)""")
def citation_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations numbered by first appearance."""
    return ordered.citation_numbers(marked_sections(spark, sf_dir), "l_orderkey", "text")


ASSIGNED = r"""drafted AS (SELECT o_orderkey AS section, coalesce(string_agg('Shown [@' || l_partkey || '].', ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_returnflag <> 'N'), '') AS text,
    coalesce(list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_linenumber % 2 = 0), []) AS assigned FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
marked AS (SELECT section, regexp_extract_all(text, '\[@([^\]]+)\]', 1) AS m, assigned FROM drafted),
split AS (SELECT section, list(id ORDER BY id) FILTER (p_partkey IS NOT NULL) AS valid, list(id ORDER BY id) FILTER (p_partkey IS NULL) AS invalid FROM (SELECT DISTINCT section, unnest(m) AS id FROM marked) LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 25) ON CAST(p_partkey AS VARCHAR) = id GROUP BY 1)"""


def drafted_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section for each order, with markers for some of its lines, and the parts assigned to it."""
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    raw = lambda p: p["l_partkey"].cast("string")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("section")).agg(F.array_sort(F.collect_list(at)).alias("lines"))
    text = F.array_join(F.transform(F.filter("lines", lambda p: p["l_returnflag"] != "N"), lambda p: F.concat(F.lit("Shown [@"), raw(p), F.lit("]."))), " ")
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section")).join(lines, "section", "left")
    return found.select("section", text.alias("text"), F.transform(F.filter("lines", lambda p: p["l_linenumber"] % 2 == 0), raw).alias("assigned"))


@query(f"""WITH {ASSIGNED} SELECT section, coalesce(array_to_string(valid, ','), '') AS valid, coalesce(array_to_string(invalid, ','), '') AS invalid, array_to_string(list_sort(list_filter(assigned, lambda x: NOT list_contains(m, x))), ',') AS uncited,
    len(m) AS markers, len(list_distinct(m)) AS unique_markers FROM marked LEFT JOIN split USING (section)""")
def citation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section's citations: valid, unknown, and assigned papers that it does not cite."""
    known = table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").cast("string").alias("id"))
    found = validation.validate_sections(drafted_sections(spark, sf_dir), known, ["section"])
    return found.select("section", *(F.array_join(c, ",").alias(c) for c in ("valid", "invalid", "uncited")), "markers", "unique_markers")


@query(f"""WITH {ASSIGNED}, i AS (SELECT section, 'critical' AS severity, unnest(invalid) AS id FROM split UNION ALL SELECT section, 'major', unnest(list_filter(assigned, lambda x: NOT list_contains(m, x))) FROM marked)
SELECT CAST(section AS VARCHAR) AS location, severity, CASE severity WHEN 'critical' THEN '[@' || id || '] cites a paper that is not in the corpus' ELSE '[@' || id || '] was assigned and is not cited' END AS description,
    CASE severity WHEN 'critical' THEN 'remove [@' || id || '] or cite a paper of the corpus' ELSE 'cite [@' || id || '] or take it off the section' END AS suggested_fix FROM i""")
def citation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults in the citations of all sections, one a row."""
    known = table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").cast("string").alias("id"))
    return validation.issues(validation.validate_sections(drafted_sections(spark, sf_dir), known, ["section"]), "section")


@query(r"""WITH l AS (SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) - 1 AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)),
m AS (SELECT *, CAST(sum(CAST(regexp_matches(line, '^[A-E]') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS entry FROM l)
SELECT doc_id, entry, md5(string_agg(trim(line), ' ' ORDER BY no)) AS text, count(*) AS n_lines FROM m WHERE entry > 0 GROUP BY doc_id, entry""")
def continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that go on with the entry before them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return ordered.continued_lines(lines, "doc_id", "no", "line", "^[A-E]").withColumn("text", F.md5("text"))


@query("SELECT conv_id, turn, right(lag(text) OVER w, 100) AS before, lag(turn) OVER w AS prev_pos, lead(turn) OVER w AS next_pos FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbor_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End of the section before, and the places around."""
    return joins.neighbours(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 100).select("conv_id", "turn", "before", "prev_pos", "next_pos")


@query("SELECT l_partkey, count(*) AS cited FROM lineitem GROUP BY 1 ORDER BY cited DESC, l_partkey LIMIT 10")
def topk_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most cited papers."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("cited")).orderBy(F.desc("cited"), "l_partkey").limit(10)


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 99 END, o_orderkey) AS INTEGER) AS place
FROM orders QUALIFY place <= 5""")
def severity_sort_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five gravest issues of each section, others last, in order."""
    grade = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(99)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(grade, "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", place.alias("place")).filter("place <= 5")


@query("""SELECT l_suppkey, dimension, CAST(cents AS BIGINT) AS cents FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS dimension, sum(CAST(round(l_discount * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY cents, dimension) <= 2""")
def weakest_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two weakest dimensions of each target."""
    scores = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("dimension")).agg(F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("cents"))
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("cents", "dimension"))
    return scores.withColumn("_n", place).filter("_n <= 2").drop("_n")


@query("""SELECT a.l_suppkey, string_agg(CAST(a.l_partkey AS VARCHAR), ',' ORDER BY a.l_partkey) AS only_generated FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'N') a
WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_suppkey = a.l_suppkey AND b.l_partkey = a.l_partkey AND b.l_returnflag = 'N') GROUP BY 1""")
def ordered_list_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics generated and not in the reference, in order."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    made, wanted = lines.filter("l_returnflag <> 'N'").select("l_suppkey", "l_partkey").distinct(), lines.filter("l_returnflag = 'N'").select("l_suppkey", "l_partkey").distinct()
    left = made.join(wanted, ["l_suppkey", "l_partkey"], "left_anti")
    return left.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",").alias("only_generated"))


@query("SELECT user_id, event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS BIGINT) AS batch FROM events")
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of twenty papers, in order."""
    return ordered.batches(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 20).select("user_id", "event_id", "batch")


TREE = """turns AS (SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS t FROM conversations), edges AS (
    SELECT DISTINCT conv_id || ':' || t AS node, CASE WHEN t > 0 THEN conv_id || ':' || (t - 1) // 2 END AS dep FROM turns UNION SELECT conv_id || ':' || t, conv_id || ':' || (t - 1) FROM turns WHERE t > 0)"""


def dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation depends on the one before and on the one at half its place."""
    first = F.min("turn").over(Window.partitionBy("conv_id"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") - first).cast("long").alias("t"))
    node = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    half = turns.select(node(F.col("t")).alias("node"), F.when(F.col("t") > 0, node(F.floor((F.col("t") - 1) / 2))).alias("dep"))
    return half.unionByName(turns.filter("t > 0").select(node(F.col("t")).alias("node"), node(F.col("t") - 1).alias("dep")))


@query(f"WITH RECURSIVE {TREE}, walk AS (SELECT node, 0 AS level FROM edges WHERE dep IS NULL UNION SELECT e.node, w.level + 1 FROM walk w JOIN edges e ON e.dep = w.node) SELECT node, max(level) AS level FROM walk GROUP BY node")
def dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a dependency graph."""
    return trees.dag_levels(dag_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {TREE}, walk AS (SELECT DISTINCT node, 0 AS depth FROM edges WHERE node LIKE '%:1' UNION SELECT e.node, w.depth + 1 FROM walk w JOIN edges e ON e.dep = w.node) SELECT node, min(depth) AS depth FROM walk GROUP BY node")
def downstream_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes to run again from the second turns on."""
    edges = dag_edges(spark, sf_dir)
    return trees.downstream(edges, edges.filter(F.col("node").like("%:1")).select("node"))


@query("""WITH RECURSIVE s AS (SELECT conv_id AS doc, turn AS section, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, turn AS pos FROM (SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS turn FROM conversations)),
tree AS (SELECT doc, section, lpad(CAST(pos AS VARCHAR), 6, '0') AS path, 1 AS depth FROM s WHERE parent IS NULL UNION ALL SELECT s.doc, s.section, path || '.' || lpad(CAST(s.pos AS VARCHAR), 6, '0'), depth + 1 FROM tree t JOIN s ON s.doc = t.doc AND s.parent = t.section)
SELECT doc, section, depth, CAST(row_number() OVER (PARTITION BY doc ORDER BY path) AS INTEGER) AS place FROM tree""")
def outline_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each outline in reading order."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") - F.min("turn").over(Window.partitionBy("conv_id"))).alias("turn"))
    sections = turns.select(F.col("conv_id").alias("doc"), F.col("turn").alias("section"), F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)).alias("parent"), F.col("turn").alias("pos"))
    return trees.outline(sections)
