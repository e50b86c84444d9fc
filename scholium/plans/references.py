"""Queries on reference lines, cited answers and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import references
from scholium.operators import answers, evaluation, matching, ordered
from scholium.plans.registry import query
from scholium.session import materialise, shared_folder, table
from scholium.sources import reports

NL = "' || chr(10) || '"


@query(rf"""WITH b AS (SELECT doc_id, regexp_extract(text || '{NL}## References{NL}[1] Doe, J. ' || split_part(text, chr(10), 1) || '{NL}  J. Data, 2020{NL}Figure 1 shows{NL}2. Roe. Short. A longer title here. Nature 10.1234/Ab' || doc_id || '.), x', '(?ims)^#{{1,3}}\s*(?:references|bibliography)(.*)\z', 1) AS r FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS no FROM (SELECT doc_id, list_transform(string_split(r, chr(10)), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')) AS x FROM b)),
s AS (SELECT *, regexp_matches(line, '^\[\d+\]\s+\S|^\d+\.\s+[A-Z]') AS starts FROM l WHERE line <> ''),
e AS (SELECT *, CAST(sum(CAST(starts AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS entry FROM s WHERE starts OR NOT regexp_matches(line, '(?i)^(figure|table|appendix|footnote)')),
g AS (SELECT doc_id, entry, string_agg(line, ' ' ORDER BY no) AS raw FROM e WHERE entry > 0 GROUP BY ALL),
p AS (SELECT *, regexp_replace(raw, '^\[?\d+[\]\.]\s*', '') AS bare, string_split(regexp_replace(regexp_replace(raw, '^\s*(?:\[\d+\]|\d+\.)\s*', ''), '^\s+|\s+$', '', 'g'), '. ') AS parts FROM g)
SELECT doc_id, entry, md5(raw) AS raw, nullif(regexp_replace(regexp_extract(raw, '10\.\d{{4,9}}/[^\s,;)\]]+'), '[.,;)]+$', ''), '') AS doi, nullif(regexp_replace(lower(regexp_extract(raw, '10\.\d{{4,}}/\S+')), '[.,;)]+$', ''), '') AS matched_doi,
    coalesce(regexp_split_to_array(bare, '\.\s+')[2], bare) AS second_part,
    CASE WHEN len(parts) < 2 THEN left(parts[1], 200) ELSE regexp_replace(regexp_replace(coalesce(list_filter(parts[2:], lambda s, i: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) >= 3 OR i >= 3)[1], parts[2]), '^\s+|\s+$', '', 'g'), '\.+$', '') END AS title FROM p""")
def reference_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference lists of markdown texts: lines joined, DOIs and titles of each."""
    made = F.concat("text", F.lit("\n## References\n[1] Doe, J. "), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("\n  J. Data, 2020\nFigure 1 shows\n2. Roe. Short. A longer title here. Nature 10.1234/Ab"), F.col("doc_id").cast("string"), F.lit(".), x"))
    lists = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(references.after_header(made), "\n")).alias("no", "line"))
    lines = lists.withColumn("line", references.stripped(F.col("line"))).filter("line <> ''")
    entries = ordered.continued_lines(lines, "doc_id", "no", "line", references.NUMBERED, skip=references.CAPTION)
    raw = F.col("text")
    return entries.select("doc_id", "entry", F.md5(raw).alias("raw"), references.listed_doi(raw).alias("doi"), references.matched_doi(raw).alias("matched_doi"), references.second_part(raw).alias("second_part"), references.likely_title(raw).alias("title"))


def cited_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Generated and reference lists of orders: some by DOI, some with equal, changed or other titles."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("review"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("p_partkey")).groupBy("review", "id").agg(F.min("p_partkey").alias("p_partkey"))
    named = lines.join(table(spark, sf_dir, "part"), "p_partkey").withColumn("kind", (F.col("p_partkey") + F.col("id")) % 5)
    title = F.concat_ws(" ", "p_name", F.lower("p_type"), F.concat(F.lit("growth"), F.col("p_size").cast("string")))
    changed = F.when(F.col("kind") < 2, title).when(F.col("kind") == 2, F.translate(title, "aeo", "eao")).when(F.col("kind") == 3, F.replace(title, F.lit("growth"), F.lit("grow"))).otherwise(F.reverse(title))
    doi = F.when(F.col("kind") % 2 == 0, F.concat(F.lit(" 10.1234/"), F.col("p_partkey").cast("string"))).otherwise("")
    line = lambda t, d: F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] Doe J. "), t, F.lit(". Journal."), d)
    return named.select("review", "id", line(changed, F.when(F.col("kind") == 4, doi).otherwise("")).alias("ref")), named.select("review", "id", line(title, doi).alias("ref"))


@query()
def citation_match_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched, missed and invented references of each review, both ways."""
    return matching.match_citations(*cited_lines(spark, sf_dir))


ANSWER = "replace(text, '. ', ' [1][2]. ') || ' Published (2019) see [3].'"


@query(rf"""WITH a AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, string_split(regexp_replace({ANSWER}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)),
c AS (SELECT doc_id, CAST(ref AS INTEGER) AS idx, arg_min(clean, pos) AS context FROM (SELECT doc_id, pos, unnest(regexp_extract_all(sentence, '\[(\d+)\]', 1)) AS ref, regexp_replace(regexp_replace(sentence, '\[(\d+)\]', '', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM a) WHERE clean <> '' GROUP BY ALL)
SELECT doc_id, idx, md5(context) AS context FROM c""")
def answer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of an answer that cites each number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(ANSWER).alias("text"))
    return answers.contexts(docs, "doc_id", "text").withColumn("context", F.md5("context"))


@query(r"""WITH c AS (SELECT page_id, page_id // 3 AS answer, CAST(page_id % 3 + 1 AS INTEGER) AS idx, CASE WHEN page_id % 4 = 0 THEN 'http://doi.org/10.1234/' || 'measured-growth_rates-' || page_id || CASE WHEN page_id % 8 = 0 THEN '/' ELSE '.' END ELSE 'http://h.org/' || (1890 + page_id) || '/drought-and-' || 'rivers-of-' || page_id || '.pdf' END AS url FROM pages)
SELECT page_id, regexp_replace(nullif(regexp_extract(url, '(?i)doi\.org/(10\.\d{4,9}/[^\s]+)', 1), ''), '\.+$', '') AS doi,
    coalesce(CASE WHEN TRY_CAST(nullif(regexp_extract(url, '/(\d{4})[/.\-]', 1), '') AS INTEGER) BETWEEN 1900 AND 2030 THEN TRY_CAST(regexp_extract(url, '/(\d{4})[/.\-]', 1) AS INTEGER) END, CASE WHEN idx = 3 AND d.doc_id IS NOT NULL THEN 2019 END) AS year,
    CASE WHEN page_id % 4 = 0 THEN 'Measured Growth Rates ' || page_id || CASE WHEN page_id % 8 = 0 THEN '' ELSE '.' END ELSE 'Drought And Rivers Of ' || page_id END AS title, d.doc_id IS NOT NULL AND idx = 3 AS dated FROM c LEFT JOIN documents d ON d.doc_id = answer""")
def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited URLs of answers as papers; those without a title are dropped."""
    p = F.col("page_id")
    url = F.when(p % 4 == 0, F.concat(F.lit("http://doi.org/10.1234/measured-growth_rates-"), p.cast("string"), F.when(p % 8 == 0, "/").otherwise("."))).otherwise(F.concat(F.lit("http://h.org/"), (1890 + p).cast("string"), F.lit("/drought-and-rivers-of-"), p.cast("string"), F.lit(".pdf")))
    cited = table(spark, sf_dir, "pages").select("page_id", F.floor(p / 3).alias("answer"), (p % 3 + 1).cast("int").alias("idx"), url.alias("url"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer"), F.lit("Published (2019) see [3].").alias("text"))
    found = answers.papers(cited, answers.contexts(docs, "answer", "text"), "answer")
    return found.select("page_id", "doi", "year", "title", F.col("abstract").isNotNull().alias("dated"))


@query(r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Given Title' ELSE 'Drought And Rivers Of ' || page_id END AS title, CASE page_id % 4 WHEN 0 THEN 'A. One|B. Two' WHEN 1 THEN 'C. Three' ELSE '' END AS authors,
    CASE page_id % 5 WHEN 0 THEN 2011 WHEN 1 THEN 2015 WHEN 2 THEN CASE WHEN 1890 + page_id BETWEEN 1900 AND 2030 THEN 1890 + page_id END ELSE CASE WHEN 1890 + page_id BETWEEN 1900 AND 2030 THEN 1890 + page_id END END AS year,
    CASE WHEN page_id % 6 = 0 THEN '10.7/own' END AS doi, CASE page_id % 7 WHEN 0 THEN 'A snippet.' WHEN 1 THEN 'An abstract.' ELSE 'Said so before .' END AS abstract FROM pages WHERE page_id % 11 > 0""")
def answer_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation objects of answers as papers, what they lack taken from their URL or the answer; strings are passed over."""
    p = F.col("page_id")
    text = lambda name, value: F.concat(F.lit(f'"{name}": "'), value, F.lit('"'))
    url = F.concat(F.lit("http://h.org/"), (1890 + p).cast("string"), F.lit("/drought-and-rivers-of-"), p.cast("string"), F.lit(".pdf"))
    fields = [
        text("url", url), F.when(p % 3 == 0, F.lit('"title": "Given Title"')).otherwise(F.lit('"title": ""')),
        F.when(p % 4 == 0, F.lit('"author": "A. One, B. Two ,"')).when(p % 4 == 1, F.lit('"author": "", "authors": [" C. Three", "", null]')),
        F.when(p % 5 == 0, F.lit('"published_date": 2011')).when(p % 5 == 1, F.lit('"published_date": "", "year": "printed 2015, 1999"')).when(p % 5 == 2, F.lit('"published_date": "soon"')),
        F.when(p % 6 == 0, F.lit('"doi": "10.7/own"')), F.when(p % 7 == 0, F.lit('"snippet": "A snippet."')).when(p % 7 == 1, F.lit('"snippet": null, "abstract": "An abstract."')),
    ]
    made = F.when(p % 11 == 0, F.concat(F.lit('"'), url, F.lit('"'))).otherwise(F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")))
    cited = table(spark, sf_dir, "pages").select("page_id", F.lit(1).alias("idx"), made.alias("citation"))
    told = table(spark, sf_dir, "pages").select("page_id", F.lit("Said so before [1]. And so on.").alias("text"))
    found = answers.structured(cited, answers.contexts(told, "page_id", "text"), "page_id")
    return found.select("page_id", "title", F.array_join("authors", "|").alias("authors"), "year", "doi", "abstract")


@query(r"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS pmid, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'pmc' ELSE '' END || p_partkey END AS pmcid, CASE WHEN p_partkey % 4 = 0 THEN '10.1101/' ELSE '10.1/' END || p_partkey AS doi, '2101.' || p_partkey || 'v' || p_size AS arxiv FROM part),
j AS (SELECT p.*, coalesce(p.pmcid, k.pmcid) AS found, source FROM p LEFT JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS pmid, 'PMC9' || s_suppkey AS pmcid FROM supplier) k ON k.pmid = p.pmid LEFT JOIN (SELECT '10.1/' || doc_id AS doi, source FROM documents) o ON o.doi = p.doi)
SELECT p_partkey, CASE WHEN upper(found) LIKE 'PMC%' THEN found ELSE 'PMC' || found END AS pmcid, 'http://oa.org/' || source AS location, 'https://arxiv.org/pdf/' || regexp_replace(arxiv, 'v\d+$', '') AS arxiv_url, CASE WHEN doi LIKE '10.1101/%' THEN 'https://www.biorxiv.org/content/' || doi || 'v1.full.pdf' END AS preprint_url FROM j""")
def key_lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and locations of papers by lookup, their own keys first."""
    p = F.col("p_partkey")
    own = F.when(p % 3 == 0, F.concat(F.when(p % 2 == 0, "pmc").otherwise(""), p.cast("string")))
    papers = table(spark, sf_dir, "part").select("p_partkey", F.when(p % 5 != 0, p.cast("string")).alias("pmid"), own.alias("pmcid"), F.concat(F.when(p % 4 == 0, "10.1101/").otherwise("10.1/"), p.cast("string")).alias("doi"), F.concat(F.lit("2101."), p.cast("string"), F.lit("v"), F.col("p_size").cast("string")).alias("arxiv"))
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("pmid"), F.concat(F.lit("PMC9"), F.col("s_suppkey").cast("string")).alias("pmcid"))
    places = table(spark, sf_dir, "documents").select(F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("doi"), F.concat(F.lit("http://oa.org/"), "source").alias("location"))
    return answers.located(papers, keys, places).select("p_partkey", "pmcid", "location", "arxiv_url", "preprint_url")


@query("""WITH r AS (SELECT p_brand, p_partkey, p_size * 4 AS cites, p_partkey % 3 <> 2 AS review FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 10),
b AS (SELECT * FROM (SELECT *, CASE WHEN cites >= 50 AND review THEN 0 WHEN cites >= 100 THEN 1 END AS tier FROM r) WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY tier, cites DESC, p_partkey) = 1),
e AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem)
SELECT p_brand, b.p_partkey, CAST(cites AS INTEGER) AS cites, tier, (SELECT string_agg('10.1/a' || l_suppkey, ',' ORDER BY n) FROM e WHERE e.l_partkey = b.p_partkey AND n <= 1000 AND l_suppkey % 7 <> 0) AS dois FROM b""")
def benchmark_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most cited review of each topic's first ten results, else its most cited paper, with the DOIs it refers to."""
    p = F.col("p_partkey")
    types = F.when(p % 3 == 0, F.array(F.lit("Review"))).when(p % 3 == 1, F.array(F.lit("Article"), F.lit("Meta-Analysis")))
    results = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") * 4).alias("cites"), types.alias("types"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("at"), F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit(" 10.1/A"), F.col("l_suppkey").cast("string"), F.lit(" "))).alias("doi"))
    best = answers.best_review(results, "p_brand", "p_partkey")
    return best.join(answers.reference_dois(edges, "p_partkey", "at"), "p_partkey", "left").select("p_brand", "p_partkey", "cites", "tier", F.when(F.size("dois") > 0, F.array_join("dois", ",")).alias("dois"))


@query("""SELECT doc_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, replace(lang || ' ' || source, ' ', '_') AS output_key, doc_id // 20 AS batch, doc_id % 20 AS index, CASE WHEN doc_id % 5 = 0 THEN '' ELSE md5(text) END AS abstract,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(n_chars AS BIGINT) END AS n, doc_id % 3 = 0 AS rejected FROM documents JOIN (SELECT event_id, ts FROM events) e ON event_id = doc_id""")
def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers as rows of a prompt, keys and stamps of their files, and replies that keep to the schema or not."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts"), "doc_id")
    reply = F.when(F.col("doc_id") % 3 == 0, F.lit('{"n": "many"}')).otherwise(F.to_json(F.struct(F.col("n_chars").alias("n"))))
    read = F.from_json(reply, "n long, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    found = docs.withColumn("r", read)
    abstract = F.coalesce(F.when(F.col("doc_id") % 5 != 0, F.md5("text")), F.lit(""))
    return found.select("doc_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"), F.replace(F.concat_ws(" ", "lang", "source"), F.lit(" "), F.lit("_")).alias("output_key"), F.floor(F.col("doc_id") / 20).alias("batch"), (F.col("doc_id") % 20).alias("index"), abstract.alias("abstract"), F.col("r.n").alias("n"), F.col("r._corrupt").isNotNull().alias("rejected"))


@query()
def evaluated_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a review: its scores and report, and the size of its domain from the reports that a sink wrote and gave back."""
    generated, reference = cited_lines(spark, sf_dir)
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    shown = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    text = lines.groupBy(F.col("l_orderkey").alias("review")).agg(F.array_join(F.transform(shown, lambda p: F.concat(F.lit("## Part\nIt grows by "), p["l_partkey"].cast("string"), F.lit(" in all ["), p["l_linenumber"].cast("string"), F.lit("]."))), "\n").alias("text"))
    reviews = orders.select(F.col("o_orderkey").alias("review"), F.col("o_orderstatus").alias("domain"), F.col("o_orderpriority").alias("tier")).join(text, "review", "left")
    topics = lines.select(F.col("l_orderkey").alias("review"), (F.col("l_partkey") % 7).cast("string").alias("topic"), "l_returnflag").groupBy("review", "topic").agg(F.bool_or(F.col("l_returnflag") != "N").alias("in_generated"), F.bool_or(F.col("l_returnflag") != "A").alias("in_reference"))
    judged = lines.filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("review"), F.when(F.col("l_linenumber") == 1, "synthesis").otherwise("writing").alias("part"), (F.col("l_partkey") % 6).cast("double").alias("generated"), (F.col("l_suppkey") % 6).cast("double").alias("reference"))
    scores = judged.groupBy("review", "part").agg(F.max("generated").alias("generated"), F.max("reference").alias("reference")).withColumn("dimensions", F.create_map(F.lit("depth"), F.col("generated")))
    results = materialise(evaluation.evaluate(reviews, generated, reference, topics, scores))
    folder = shared_folder(spark)
    reports.save(results.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overall"), 4).alias("overall")).select(F.concat(F.lit("domain-"), "domain", F.lit(".json")).alias("name"), F.to_json(F.struct("domain", "n", "overall")).alias("body")), folder)
    saved = results.select("review", "domain", "overall", F.col("citations.recall").alias("recall"), F.col("topics.coverage").alias("coverage"), F.col("structure.words").alias("words"), F.md5(evaluation.report(F.lit("2026-01-01"))).alias("report"))
    summaries = reports.read(spark, folder).select(F.get_json_object("body", "$.domain").alias("domain"), F.get_json_object("body", "$.n").cast("long").alias("in_domain"))
    return saved.join(summaries, "domain", "left")
