"""Queries on drafts for output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.operators import drafts
from scholium.plans.registry import query
from scholium.plans.sequences import MARKS, SECTIONS, marked_sections
from scholium.session import table

ESCAPED = r"replace(replace(replace(replace(replace(replace(replace(replace(replace({t}, '&', '\&'), '%', '\%'), '$', '\$'), '#', '\#'), '_', '\_'), '{{', '\{{'), '}}', '\}}'), '~', '\textasciitilde{{}}'), '^', '\^{{}}')"


def cited_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of parts: id, authors (some none), title, journal, year and DOI (some missing)."""
    p = F.col("p_partkey")
    authors = F.when(p % 3 != 0, F.array(F.concat(F.lit("Au"), F.col("p_size").cast("string"), F.lit(" Given")), F.lit("Second B"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").filter("p_size < 25").select(p.cast("string").alias("id"), authors.alias("authors"), F.col("p_name").alias("title"), F.when(p % 2 == 0, F.col("p_type")).alias("journal"), F.when(p % 5 != 0, 1990 + F.col("p_size")).alias("year"), F.when(p % 4 != 0, F.concat(F.lit("10.1/"), p.cast("string"))).alias("doi"))


@query(f"""WITH {SECTIONS}, {MARKS}, n AS (SELECT l_orderkey, cited, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(place)) AS number FROM marks GROUP BY l_orderkey, cited),
l AS (SELECT l_orderkey, place, '[' || number || ']' AS v, CASE WHEN p_partkey % 3 <> 0 THEN '(Au' || p_size || ', ' || CASE WHEN p_partkey % 5 <> 0 THEN CAST(1990 + p_size AS VARCHAR) ELSE 'n.d.' END || ')' ELSE '[' || number || ']' END AS a
    FROM marks JOIN n USING (l_orderkey, cited) LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON p_partkey = CAST(cited AS BIGINT))
SELECT l_orderkey, string_agg('Shown ' || a || '.', ' ' ORDER BY place) AS apa, string_agg('Shown ' || v || '.', ' ' ORDER BY place) AS vancouver FROM l GROUP BY 1""")
def citation_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section texts with their markers resolved in two styles."""
    texts, papers = marked_sections(spark, sf_dir), cited_papers(spark, sf_dir)
    apa = drafts.resolve_markers(texts, papers, "l_orderkey", "text").withColumnRenamed("text", "apa")
    return apa.join(drafts.resolve_markers(texts, papers, "l_orderkey", "text", "vancouver").withColumnRenamed("text", "vancouver"), "l_orderkey")


@query(rf"""WITH d AS (SELECT doc_id, string_split('# A & B' || chr(10) || replace(text, chr(10), chr(10) || repeat('#', CAST(1 + doc_id % 5 AS INTEGER)) || ' ') || ' [@0123456789abcdef] [@x]', chr(10)) AS t FROM documents)
SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(t, lambda x: CASE WHEN starts_with(x, '# ') THEN '\section{{' || {ESCAPED.format(t="substr(x, 3)")} || '}}' WHEN starts_with(x, '## ') THEN '\section{{' || {ESCAPED.format(t="substr(x, 4)")} || '}}'
    WHEN starts_with(x, '### ') THEN '\subsection{{' || {ESCAPED.format(t="substr(x, 5)")} || '}}' WHEN starts_with(x, '#### ') THEN '\subsubsection{{' || {ESCAPED.format(t="substr(x, 6)")} || '}}' ELSE x END), chr(10)), '\[@([^\]]{{1,12}})[^\]]*\]', '\\cite{{\1}}', 'g')) AS latex FROM d""")
def latex_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts as LaTeX bodies with cite commands."""
    made = F.concat(F.lit("# A & B\n"), F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), F.repeat(F.lit("#"), (1 + F.col("doc_id") % 5).cast("int")), F.lit(" "))), F.lit(" [@0123456789abcdef] [@x]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(drafts.latex_cites(drafts.latex_body(made))).alias("latex"))


@query(rf"""SELECT CAST(p_partkey AS VARCHAR) AS id, '@article{{' || left(CAST(p_partkey AS VARCHAR), 12) || ',' || chr(10) || '  author = {{' || CASE WHEN p_partkey % 3 <> 0 THEN 'Au' || p_size || ' Given and Second B' ELSE 'Unknown' END || '}},' || chr(10) || '  title = {{' || {ESCAPED.format(t="p_name")} || '}},' || chr(10)
    || '  journal = {{' || CASE WHEN p_partkey % 2 = 0 THEN {ESCAPED.format(t="p_type")} ELSE '' END || '}},' || chr(10) || '  year = {{' || CASE WHEN p_partkey % 5 <> 0 THEN 1990 + p_size ELSE 0 END || '}},' || chr(10) || '  doi = {{' || CASE WHEN p_partkey % 4 <> 0 THEN '10.1/' || p_partkey ELSE '' END || '}}' || chr(10) || '}}' AS entry
FROM part WHERE p_size < 25""")
def bibtex_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BibTeX entries of papers."""
    return cited_papers(spark, sf_dir).select("id", drafts.bibtex(*(F.col(c) for c in ("id", "authors", "title", "journal", "year", "doi"))).alias("entry"))
