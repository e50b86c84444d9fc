"""Queries on rounds that add papers, on findings and on assembled drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.operators import evidence, remediation, rounds, trees
from scholium.plans.corpus import FOLD
from scholium.plans.registry import query
from scholium.session import table


def joined(listed, sep: str = ","):
    return F.array_join(F.transform(listed, lambda x: x.cast("string")), sep)


@query("""WITH e AS (SELECT source AS db, lang || n_chars % 50 AS q FROM documents), n AS (SELECT 'src' || doc_id % 12 AS db, 'fr' || doc_id % 70 AS q FROM labels)
SELECT db, q, count(*) AS n FROM (SELECT * FROM e UNION ALL SELECT db, q FROM n WHERE db IN (SELECT db FROM e) AND NOT EXISTS (SELECT 1 FROM e WHERE e.db = n.db AND e.q = n.q)) GROUP BY ALL""")
def query_expansion_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query strings of each source with new ones that it does not have."""
    existing = table(spark, sf_dir, "documents").select(F.col("source").alias("db"), F.concat("lang", (F.col("n_chars") % 50).cast("string")).alias("q"))
    new = table(spark, sf_dir, "labels").select(F.concat(F.lit("src"), (F.col("doc_id") % 12).cast("string")).alias("db"), F.concat(F.lit("fr"), (F.col("doc_id") % 70).cast("string")).alias("q"))
    return rounds.append_absent(existing, new, "db", "q").groupBy("db", "q").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT l_orderkey, l_suppkey % 5 AS p, l_returnflag = 'N' AS fresh, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
k AS (SELECT l_orderkey, p, n, 0 AS part FROM l WHERE NOT fresh UNION ALL SELECT l_orderkey, p, min(n), 1 FROM l WHERE fresh AND NOT EXISTS (SELECT 1 FROM l o WHERE o.l_orderkey = l.l_orderkey AND o.p = l.p AND NOT o.fresh) GROUP BY l_orderkey, p)
SELECT o_orderkey, coalesce((SELECT string_agg(CAST(p AS VARCHAR), ',' ORDER BY part, n) FROM k WHERE l_orderkey = o_orderkey), '') AS papers FROM orders""")
def section_papers_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of each section with the new ones that it does not have, in order."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    listed = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, row))), lambda r: r["l_suppkey"] % 5)
    fresh = F.col("l_returnflag") == "N"
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(listed(~fresh).alias("old"), listed(fresh).alias("new"))
    found = table(spark, sf_dir, "orders").select("o_orderkey").join(lists, "o_orderkey", "left")
    return found.select("o_orderkey", F.coalesce(joined(rounds.appended(F.col("old"), F.col("new"))), F.lit("")).alias("papers"))


@query("SELECT d.doc_id, quality IS NOT NULL AS screened, CASE WHEN quality IS NOT NULL THEN 'enriched ' || source ELSE source END AS title FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def prefer_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screened copies of papers, and the candidates that were not screened."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    screened = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id").select("doc_id", F.lit(True).alias("screened"), F.concat(F.lit("enriched "), "source").alias("title"))
    return rounds.preferred(screened, docs.select("doc_id", F.lit(False).alias("screened"), F.col("source").alias("title")), "doc_id")


@query("""WITH d AS (SELECT doc_id, quality + 2 * toxic + CAST(doc_id % 3 AS INTEGER) AS s, CAST(doc_id % 7 AS INTEGER) AS again FROM labels)
SELECT doc_id, least(5, greatest(1, CASE WHEN s >= 3 THEN s ELSE again END)) AS score, s < 3 AS promoted FROM d WHERE s >= 3 OR (greatest(1, s) = 2 AND again >= 3 AND doc_id % 2 = 0)""")
def borderline_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screened papers and the borderline ones that a second look promotes."""
    labels = table(spark, sf_dir, "labels")
    first = labels.select("doc_id", (F.col("quality") + 2 * F.col("toxic") + (F.col("doc_id") % 3).cast("int")).alias("score"))
    second = labels.filter(F.col("doc_id") % 2 == 0).select("doc_id", (F.col("doc_id") % 7).cast("int").alias("score"))
    return rounds.screened_with_promotions(first, second, "doc_id")


@query("""WITH g AS (SELECT o_custkey AS topic, o_orderpriority = '1-URGENT' AS major, 0.6 + o_custkey % 5 * 0.1 AS coverage, o_orderkey % 6 AS q FROM orders),
t AS (SELECT topic FROM g GROUP BY 1 HAVING bool_or(major) OR min(coverage) < 0.75), a AS (SELECT DISTINCT topic, q FROM (SELECT topic, q FROM g UNION ALL SELECT topic, q + 1 FROM g) JOIN t USING (topic)),
f AS (SELECT o_custkey AS topic, l_partkey % 9 AS q, l_partkey AS id, CASE WHEN l_partkey % 4 <> 0 THEN '10.1/a' || l_suppkey % 40 END AS doi, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT topic, id, doi, n, added FROM (SELECT topic, id, doi, count(*) AS n, false AS added FROM f WHERE l_returnflag = 'N' GROUP BY ALL
UNION ALL SELECT topic, id, doi, count(*), true FROM f WHERE l_returnflag <> 'N' AND EXISTS (SELECT 1 FROM a WHERE a.topic = f.topic AND a.q = f.q) AND NOT EXISTS (SELECT 1 FROM f o WHERE o.l_returnflag = 'N' AND o.topic = f.topic AND o.doi = f.doi) GROUP BY ALL)""")
def gap_search_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora with the papers that a gated gap search adds."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    topic = F.col("o_custkey").alias("topic")
    asked = F.col("o_orderkey") % 6
    gaps = orders.select(topic, F.when(F.col("o_orderpriority") == "1-URGENT", "major").otherwise("minor").alias("severity"), (0.6 + F.col("o_custkey") % 5 * 0.1).alias("coverage"), F.array(asked, asked + 1).alias("queries"))
    doi = F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("10.1/a"), (F.col("l_suppkey") % 40).cast("string")))
    papers = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select(topic, (F.col("l_partkey") % 9).alias("query"), F.col("l_partkey").alias("id"), doi.alias("doi"), "l_returnflag")
    found = rounds.gap_round(gaps, papers.filter("l_returnflag <> 'N'"), papers.filter("l_returnflag = 'N'"), "topic")
    return found.groupBy("topic", "id", "doi", "added").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT o_custkey AS section, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) < 15)
SELECT section, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY section ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS place FROM orders JOIN s ON section = o_custkey WHERE o_orderkey % 5 >= 2 QUALIFY place <= 5""")
def enrichment_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five adjacent papers of each section that is not well covered."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("section"), F.col("o_orderkey").alias("id"), F.struct("o_orderdate", "o_orderkey").alias("pos"), (F.col("o_orderkey") % 5).alias("score"))
    sections = orders.groupBy("section").agg(F.count(F.lit(1)).alias("n_papers"))
    return rounds.enrichment(sections, orders, "section").select("section", "id", "place")


@query("""WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, event_id, CAST(r AS INTEGER) AS round, r <= CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS executed FROM a""")
def remediation_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which remedies of a run are executed under the caps of their kinds."""
    return rounds.capped(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], {"click": 2, "view": 1}).select("user_id", "event_id", "round", "executed")


@query("""SELECT o_custkey, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS covered, count(*) AS total, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderkey) FILTER (o_orderstatus <> 'F'), '') AS uncovered,
    CASE WHEN count_if(o_orderstatus <> 'F') > 0 THEN 'warning' ELSE 'passed' END AS status FROM orders GROUP BY 1""")
def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-topics that queries cover, and those they miss."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("covered"))
    return rounds.coverage(rows, "o_custkey", "o_orderkey", "covered").withColumn("uncovered", joined(F.col("uncovered"), ", "))


FINDINGS = "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, 'claim ' || l_suppkey AS claim, CASE l_returnflag WHEN 'R' THEN 'strong' ELSE 'weak' END AS strength FROM lineitem WHERE l_returnflag <> 'N'"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of papers in order, from returned lines."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'")
    return lines.select(F.col("l_partkey").alias("paper"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("pos"), F.concat(F.lit("claim "), F.col("l_suppkey").cast("string")).alias("claim"), F.when(F.col("l_returnflag") == "R", "strong").otherwise("weak").alias("strength"))


@query(f"""WITH f AS (SELECT * FROM ({FINDINGS}) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1),
c AS (SELECT l_orderkey AS chain, l_partkey AS paper, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS place FROM lineitem)
SELECT chain, place, paper, claim, strength, CASE WHEN p_size % 4 <> 0 THEN 1990 + p_size END AS year FROM c JOIN f ON f.l_partkey = paper LEFT JOIN part ON p_partkey = paper""")
def chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of evidence chains: the first finding of each paper."""
    row = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    chains = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chain")).agg(F.transform(row, lambda r: r["l_partkey"]).alias("papers"))
    years = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("paper"), F.when(F.col("p_size") % 4 != 0, 1990 + F.col("p_size")).alias("year"))
    return rounds.chain_links(chains, findings(spark, sf_dir), years)


@query("""SELECT o_orderkey AS theme, coalesce((SELECT string_agg('- [@' || l_partkey || '] → [@' || l_suppkey || '] (' || CASE l_returnflag WHEN 'R' THEN 'contradicts' ELSE 'extends' END || '): line ' || l_linenumber, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey)
    FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'N'), '(No explicit relationships recorded)') AS lines FROM orders""")
def relation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed relations between papers of each theme as text."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'")
    kind = F.when(F.col("l_returnflag") == "R", "contradicts").otherwise("extends")
    edges = lines.select(F.col("l_orderkey").alias("theme"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), kind.alias("kind"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("description"))
    return rounds.edge_lines(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("theme")), edges)


@query(f"""SELECT l_partkey, string_agg('[' || strength || '] ' || claim, '; ' ORDER BY l_orderkey, l_linenumber, l_suppkey) AS findings, string_agg(claim, '; ' ORDER BY n) FILTER (n <= 3) AS first_three, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS n FROM ({FINDINGS})) GROUP BY 1""")
def finding_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each paper as text, and the first three."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "claim", "strength")))
    found = findings(spark, sf_dir).groupBy(F.col("paper").alias("l_partkey")).agg(listed.alias("f"))
    named = F.transform("f", lambda x: F.concat(F.lit("["), x["strength"], F.lit("] "), x["claim"]))
    return found.select("l_partkey", F.array_join(named, "; ").alias("findings"), F.array_join(F.transform(F.slice("f", 1, 3), lambda x: x["claim"]), "; ").alias("first_three"), F.size("f").cast("long").alias("n"))


@query("""SELECT p_partkey, directive FROM part LEFT JOIN (SELECT l_partkey, l_orderkey || '/' || l_linenumber || '/' || l_suppkey AS directive FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) = 1) ON l_partkey = p_partkey""")
def section_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with the last directive of their id."""
    row = ("l_orderkey", "l_linenumber", "l_suppkey")
    given = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.struct(*row).alias("pos"), F.concat_ws("/", *(F.col(c).cast("string") for c in row)).alias("directive"))
    return rounds.directives(table(spark, sf_dir, "part").select("p_partkey"), given, "p_partkey", "pos")


@query("SELECT doi FROM (SELECT lower(trim(' 10.1/A' || l_partkey || ' ')) AS doi FROM lineitem WHERE l_returnflag = 'R' UNION SELECT lower(trim('10.1/a' || p_partkey)) FROM part WHERE p_size < 10)")
def corpus_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs of candidates and screened papers, each once."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit(" 10.1/A"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("doi"))
    part = table(spark, sf_dir, "part").filter("p_size < 10").select(F.concat(F.lit("10.1/a"), F.col("p_partkey").cast("string")).alias("doi"))
    return lines.unionByName(part).select(F.lower(F.trim("doi")).alias("doi")).distinct()


@query("""WITH RECURSIVE s AS (SELECT conv_id AS doc, turn AS section, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, CASE WHEN turn % 3 = 0 THEN md5(text) END AS draft FROM (SELECT conv_id, text, turn - min(turn) OVER (PARTITION BY conv_id) AS turn FROM conversations)),
tree AS (SELECT doc, section, lpad(CAST(section AS VARCHAR), 6, '0') AS path, 1 AS depth, draft FROM s WHERE parent IS NULL UNION ALL SELECT s.doc, s.section, path || '.' || lpad(CAST(s.section AS VARCHAR), 6, '0'), depth + 1, s.draft FROM tree t JOIN s ON s.doc = t.doc AND s.parent = t.section),
p AS (SELECT doc, path, repeat('#', depth + 1) || ' S' || section || coalesce(chr(10) || chr(10) || draft, '') AS part FROM tree WHERE draft IS NOT NULL OR EXISTS (SELECT 1 FROM s WHERE s.doc = tree.doc AND s.parent = tree.section AND s.draft IS NOT NULL))
SELECT doc, '# Review ' || doc || chr(10) || coalesce((SELECT string_agg(chr(10) || chr(10) || part, '' ORDER BY path) FROM p WHERE p.doc = d.doc), '') AS draft FROM (SELECT DISTINCT doc FROM s) d""")
def assembled_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts assembled from their sections, with headings by depth."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "text", (F.col("turn") - F.min("turn").over(Window.partitionBy("conv_id"))).alias("turn"))
    sections = turns.select(F.col("conv_id").alias("doc"), F.col("turn").alias("section"), F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)).alias("parent"), F.col("turn").alias("pos"), F.concat(F.lit("S"), F.col("turn").cast("string")).alias("title"))
    drafts = turns.filter("turn % 3 = 0").select(F.col("conv_id").alias("doc"), F.col("turn").alias("section"), F.md5("text").alias("text"))
    titles = turns.select(F.col("conv_id").alias("doc")).distinct().withColumn("title", F.concat(F.lit("Review "), F.col("doc").cast("string")))
    return trees.assemble(titles, sections, drafts)


@query("""WITH l AS (SELECT o_custkey AS c, l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, l_partkey % 300 AS id, l_returnflag AS f, CASE WHEN l_partkey % 4 <> 0 THEN '10.1/a' || l_partkey % 300 END AS doi FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
k AS (SELECT c, id, row_number() OVER (PARTITION BY c ORDER BY min((o, n, s)), id) AS p FROM l WHERE f = 'R' AND NOT EXISTS (SELECT 1 FROM l x WHERE x.c = l.c AND x.f = 'N' AND x.doi = l.doi) GROUP BY c, id),
h AS (SELECT o, id, 0 AS part, row_number() OVER (PARTITION BY o ORDER BY n, s, id) AS p FROM l WHERE f = 'N'),
u AS (SELECT * FROM h UNION ALL SELECT o_orderkey, id, 1, p FROM orders JOIN k ON c = o_custkey WHERE o_orderkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM h WHERE h.o = o_orderkey AND h.id = k.id))
SELECT o_orderkey, coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY part, p) FROM u WHERE o = o_orderkey), '') AS papers FROM orders""")
def corpus_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of reviews with the papers that an expansion of the corpus finds."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("review"), F.col("o_orderkey").alias("section"))
    pos = F.struct("l_orderkey", "l_linenumber", "l_suppkey")
    paper = F.col("l_partkey") % 300
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section"), pos.alias("pos"), paper.alias("id"), F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("10.1/A"), paper.cast("string"))).alias("doi"), "l_returnflag")
    known, found = lines.filter("l_returnflag = 'N'"), lines.filter("l_returnflag = 'R'").join(orders, "section")
    have = known.groupBy("section").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("papers"))
    sections = orders.join(have, "section", "left").select("review", "section", (F.col("section") % 3 != 0).alias("asked"), F.coalesce("papers", F.array().cast("array<bigint>")).alias("papers"))
    done = rounds.expansion_round(sections, found, known.join(orders, "section"), "review")
    return done.select(F.col("section").alias("o_orderkey"), joined(F.col("papers")).alias("papers"))


STRENGTH = "CASE l_linenumber WHEN 1 THEN 'strong' WHEN 2 THEN 'moderate' WHEN 3 THEN 'weak' WHEN 4 THEN 'preliminary' ELSE 'odd' END"


@query(f"""WITH f AS (SELECT l_suppkey AS theme, count(*) AS n_findings, md5(string_agg(l_returnflag || l_partkey, ',' ORDER BY l_partkey, l_orderkey * 10 + l_linenumber, l_returnflag || l_partkey)) AS findings,
    concat_ws(',', count_if({STRENGTH} = 'strong'), count_if({STRENGTH} = 'moderate'), count_if({STRENGTH} = 'weak'), count_if({STRENGTH} = 'preliminary'), count_if({STRENGTH} = 'odd')) AS strengths FROM lineitem GROUP BY 1),
c AS (SELECT l_suppkey AS theme, count(*) AS n_contradictions FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 2 GROUP BY 1), p AS (SELECT DISTINCT l_suppkey AS theme, l_orderkey AS paper, year(l_shipdate) AS y FROM lineitem),
s AS (SELECT theme, count(*) AS n_papers, min(y) AS a, max(y) AS b FROM p GROUP BY 1), e AS (SELECT theme, count_if(y <= a + (b - a) // 2) AS n_early FROM p JOIN s USING (theme) GROUP BY 1),
g AS (SELECT l_suppkey AS theme, count(*) AS n_gaps, CASE WHEN bool_or(l_discount > 0.08) THEN 'major' ELSE 'minor' END AS severity FROM lineitem WHERE l_linenumber = 5 GROUP BY 1)
SELECT s_suppkey AS theme, s_name AS name, coalesce(n_findings, 0) AS n_findings, coalesce(findings, md5('')) AS findings, coalesce(strengths, '0,0,0,0,0') AS strengths, coalesce(n_contradictions, 0) AS n_contradictions, coalesce(n_papers, 0) AS n_papers,
    CASE WHEN n_papers >= 4 AND b - a >= 3 THEN a || '-' || b || ':' || n_early || '+' || (n_papers - n_early) END AS progression, coalesce(n_gaps, 0) AS n_gaps, severity
FROM supplier LEFT JOIN f ON f.theme = s_suppkey LEFT JOIN c ON c.theme = s_suppkey LEFT JOIN s ON s.theme = s_suppkey LEFT JOIN e ON e.theme = s_suppkey LEFT JOIN g ON g.theme = s_suppkey""")
def evidence_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is known of each theme, in one row and by one shuffle."""
    lines, of = table(spark, sf_dir, "lineitem"), F.col("l_suppkey").alias("theme")
    strength = F.when(F.col("l_linenumber") == 1, "strong").when(F.col("l_linenumber") == 2, "moderate").when(F.col("l_linenumber") == 3, "weak").when(F.col("l_linenumber") == 4, "preliminary").otherwise("odd")
    found = evidence.evidence_map(
        table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("theme"), F.col("s_name").alias("name")),
        lines.select(of, F.col("l_partkey").alias("paper"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("claim"), strength.alias("strength")),
        lines.filter("l_returnflag = 'A' AND l_linenumber = 2").select(of, F.col("l_partkey").alias("left"), F.col("l_orderkey").alias("right"), F.col("l_linestatus").alias("text")),
        lines.select(of, F.col("l_orderkey").alias("paper"), F.year("l_shipdate").alias("year")),
        lines.filter("l_linenumber = 5").select(of, F.col("l_partkey").cast("string").alias("topic"), F.when(F.col("l_discount") > 0.08, "major").otherwise("minor").alias("severity"), F.col("l_discount").alias("coverage")),
    )
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    listed = F.md5(F.array_join(F.transform("findings", lambda f: f["claim"]), ","))
    strengths = F.concat_ws(",", *(F.col(f"strengths.{s}").cast("string") for s in (*evidence.STRENGTHS, "other")))
    p = F.col("progression")
    years = F.concat(p["first_year"].cast("string"), F.lit("-"), p["last_year"].cast("string"), F.lit(":"), p["n_early"].cast("string"), F.lit("+"), p["n_late"].cast("string"))
    return found.select("theme", "name", size("findings"), listed.alias("findings"), strengths.alias("strengths"), size("contradictions"), size("papers"), years.alias("progression"), size("gaps"), "severity")


@query()
def remedied_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews (a customer's orders are its candidates) after all remedies that their caps allow, with the audit of each."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    review = F.col("o_custkey").alias("review")
    topic = lambda c: F.concat(F.lit("t"), (F.col(c) % 4).cast("string"))
    score = (1 + F.col("o_orderkey") % 7 % 4).cast("int")
    candidates = orders.select(review, F.col("o_orderkey").alias("paper"), score.alias("score"), topic("o_orderkey").alias("topic"))
    asked = orders.filter("o_orderpriority = '1-URGENT'").select(review, F.col("o_orderstatus").alias("db"), F.concat(F.lit("q"), (F.col("o_orderkey") % 9).cast("string")).alias("query")).distinct()
    bought = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(review, "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    suggested = bought.select("review", topic("l_partkey").alias("topic"), F.when(F.col("l_returnflag") == "N", "O").otherwise("F").alias("db"), F.concat(F.lit("q"), (F.col("l_suppkey") % 20).cast("string")).alias("query")).distinct()
    offers = bought.select("review", F.concat(F.lit("q"), (F.col("l_suppkey") % 20).cast("string")).alias("query"), (-F.col("l_partkey")).alias("paper"), (1 + F.col("l_linenumber") % 4).cast("int").alias("score"), topic("l_suppkey").alias("topic"))
    gaps = orders.groupBy("o_custkey", topic("o_orderkey").alias("topic")).agg(F.count(F.lit(1)).alias("n")).select(review, "topic", F.when(F.col("n") > 1, "major").otherwise("minor").alias("severity"), (F.col("n") + 1).alias("needed"))
    state = remediation.State(asked, candidates, candidates.filter("score >= 3").select("review", "paper", "topic", F.lit("first").alias("how")))
    world = remediation.World(suggested, suggested.select("review", "topic", "query"), offers, gaps)
    after, audit = remediation.remedy(state, world)
    counts = after.screened.groupBy("review").agg(F.count(F.lit(1)).alias("screened"), F.count_if(F.col("how") == "gap").alias("by_gap"), F.count_if(F.col("how") == "lowered").alias("lowered"))
    entry = F.concat_ws(":", F.col("round").cast("string"), "action", F.col("cause").cast("string"), F.col("changed").cast("string"))
    audits = audit.groupBy("review").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("audit"))
    queries = after.queries.groupBy("review").agg(F.count(F.lit(1)).alias("queries"))
    found = after.candidates.groupBy("review").agg(F.count(F.lit(1)).alias("candidates"))
    return found.join(counts, "review", "left").join(queries, "review", "left").join(audits, "review", "left").fillna(0, ["screened", "by_gap", "lowered", "queries"]).fillna("", ["audit"])


@query(f"""WITH RECURSIVE last AS (SELECT max(p_partkey) AS m FROM part), edges AS (SELECT DISTINCT l_partkey AS paper, 1 + (l_orderkey + 7 * l_suppkey) % m AS cited FROM lineitem, last), weight AS (SELECT cited, count(*) AS weight FROM edges GROUP BY 1),
h0 AS (SELECT DISTINCT l_suppkey AS passage, l_partkey AS paper FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1),
h1 AS (SELECT passage, cited AS paper, row_number() OVER (PARTITION BY passage ORDER BY weight DESC, cited) AS rank FROM (SELECT DISTINCT passage, cited FROM h0 JOIN edges USING (paper)) ANTI JOIN (SELECT passage, paper AS cited FROM h0) USING (passage, cited) JOIN weight USING (cited) QUALIFY rank <= 10),
h2 AS (SELECT passage, cited AS paper, row_number() OVER (PARTITION BY passage ORDER BY weight DESC, cited) AS rank FROM (SELECT DISTINCT passage, cited FROM h1 JOIN edges USING (paper)) ANTI JOIN (SELECT passage, paper AS cited FROM h0 UNION ALL SELECT passage, paper FROM h1) USING (passage, cited) JOIN weight USING (cited) QUALIFY rank <= 10),
found AS (SELECT passage, hop, rank, paper, CASE WHEN p_partkey % 3 > 0 THEN '10.1/' || upper(p_brand) || p_size END AS doi, p_name AS title FROM (SELECT passage, 1 AS hop, rank, paper FROM h1 UNION ALL SELECT passage, 2, rank, paper FROM h2) JOIN part ON p_partkey = paper),
given AS (SELECT row_number() OVER (ORDER BY passage, hop, rank) - 1 AS pos, * FROM found WHERE doi IS NULL OR lower(doi) NOT IN (SELECT lower('10.1/' || p_brand || p_size) FROM part WHERE p_partkey % 11 = 0)), {FOLD}
SELECT passage, hop, CAST(rank AS INTEGER) AS rank, paper, pos AS place FROM fold JOIN given ON pos = kept""")
def passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New papers that the citations of each passage lead to within two hops, by one snowball over all passages."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    last = part.agg(F.max("p_partkey").alias("m"))
    edges = lines.join(F.broadcast(last)).select(F.col("l_partkey").alias("paper"), (1 + (F.col("l_orderkey") + 7 * F.col("l_suppkey")) % F.col("m")).alias("cited"))  # one row
    passages = lines.filter("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_suppkey").alias("passage"), F.col("l_partkey").alias("paper"))
    doi = F.concat(F.lit("10.1/"), F.upper("p_brand"), F.col("p_size").cast("string"))
    papers = part.select(F.col("p_partkey").alias("paper"), F.when(F.col("p_partkey") % 3 > 0, doi).alias("doi"), F.col("p_name").alias("title"))
    return rounds.passage_search(passages, edges, papers, part.filter("p_partkey % 11 = 0").select(doi.alias("doi")))
