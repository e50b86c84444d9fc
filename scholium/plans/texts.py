"""Queries on texts: markers, URLs, markdown, JSON replies, bibliographies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.functions import bibliography, text
from scholium.functions.text import CONSONANTS, LETTERS, VOWELS
from scholium.operators import metrics, sections
from scholium.plans.registry import query
from scholium.session import shared_folder, table
from scholium.sources import markup, records
from scholium.streaming import audit


@query(r"""WITH w AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS t FROM documents)),
inv AS (SELECT doc_id, word, list(pos) AS positions FROM w GROUP BY ALL), e AS (SELECT doc_id, word, unnest(positions) AS pos FROM inv)
SELECT doc_id, md5(string_agg(word, ' ' ORDER BY pos)) AS rebuilt, count(*) AS n_words FROM e GROUP BY 1""")
def inverted_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts rebuilt from word -> positions."""
    indexed = table(spark, sf_dir, "documents").select("doc_id", text.inverted_index(F.split("text", r"\s+")).alias("index"))
    return indexed.select("doc_id", F.md5(F.array_join(text.from_index(F.col("index")), " ")).alias("rebuilt"), F.aggregate("index", F.lit(0).cast("long"), lambda n, e: n + F.size(e["places"])).alias("n_words"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(regexp_replace(split_part(text, chr(10), 1), '[^\p{L}\p{N}_\s]', ' ', 'g')), '\s+'),
    lambda w: length(w) > 1 AND w NOT IN ('a','an','the','of','in','on','at','to','for','and','or','with','by','from','that','this','is','was','are'))), ' ') AS tokens FROM documents""")
def match_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as sorted words for matching."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.match_tokens(F.split_part("text", F.lit("\n"), F.lit(1))), " ").alias("tokens"))


@query(r"SELECT page_id, regexp_replace(lower(nullif(trim('  https://dx.doi.org/10.1000/' || upper(md5(url)) || ' '), '')), '^https?://(dx\.)?doi\.org/', '') AS doi FROM pages")
def doi_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare lower-case DOIs."""
    raw = F.concat(F.lit("  https://dx.doi.org/10.1000/"), F.upper(F.md5("url")), F.lit(" "))
    return table(spark, sf_dir, "pages").select("page_id", text.doi_key(raw).alias("doi"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, TRY_CAST(nullif(regexp_extract(url || '/x', '/((19[0-9][0-9])|(20[0-2][0-9])|2030)[/.\-]', 1), '') AS INTEGER) AS year,
    regexp_extract(url, '10\.[0-9]{4,9}/[^\s,;)\]]+', 0) AS doi FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, year and DOI of each URL."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1).alias("host"), text.url_year(F.concat(url, F.lit("/x"))).alias("year"), F.regexp_extract(url, r"10\.[0-9]{4,9}/[^\s,;)\]]+", 0).alias("doi"))


@query(r"""WITH s AS (SELECT page_id, list_last(list_filter(string_split(regexp_replace(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda p: p <> '')) AS last
    FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'http://h.org/a/gut-microbiome_and-' || md5(url) || '-x.html' END AS u FROM pages))
SELECT page_id, CASE WHEN length(last) >= 8 AND NOT regexp_matches(last, '^[0-9]+$') AND NOT regexp_matches(last, '^[0-9a-fA-F\-]{5,40}$') AND length(words) >= 8
    THEN array_to_string(list_transform(range(1, length(words) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(substr(words, i - 1, 1), '^\p{L}$') THEN lower(substr(words, i, 1)) ELSE upper(substr(words, i, 1)) END), '') END AS title
FROM (SELECT *, trim(regexp_replace(regexp_replace(last, '(?i)\.(html?|pdf|xml|aspx|php)$', ''), '[-_]+', ' ', 'g')) AS words FROM s)""")
def url_slug_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from URL slugs."""
    made = F.concat(F.lit("http://h.org/a/gut-microbiome_and-"), F.md5("url"), F.lit("-x.html"))
    return table(spark, sf_dir, "pages").select("page_id", text.slug_title(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(made)).alias("title"))


@query("SELECT doc_id, md5(CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 333) || ' [...] ' || right(text, 667) END) AS cut, length(text) > 1000 AS was_cut FROM documents")
def head_tail_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to their head and tail."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.head_tail(F.col("text"), 1000, " [...] ")).alias("cut"), (F.length("text") > 1000).alias("was_cut"))


MARKDOWN = "'# **' || source || '**' || chr(10) || replace(text, chr(10), chr(10) || '## ') || ' [1] [2] [' || (doc_id % 3) || '] (Smith et al., 20' || (10 + doc_id % 2) || ') see [link](http://x) `code`'"
STRIP = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '(?m)^#{{1,6}}\s+', '', 'g'), '\*{{1,2}}|_{{1,2}}', '', 'g'), '`[^`]*`', '', 'g')"
COUNT = r"len(list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> ''))"
V, C = VOWELS, CONSONANTS
SYLLABLES = f"""list_sum(list_transform(regexp_extract_all(lower(plain), '[{V}{C}]+'), lambda w: CASE WHEN NOT regexp_matches(w, '[{V}]') THEN 1 ELSE len(regexp_extract_all(w, '[{V}]+'))
    - CASE WHEN (regexp_matches(w, '[{V}][{C}]+e$') AND NOT regexp_matches(w, '[{C}]le$')) OR (regexp_matches(w, '[{V}][{C}]+es$') AND NOT regexp_matches(w, '[sxzcgh]es$')) OR (regexp_matches(w, '[{V}][{C}]+ed$') AND NOT regexp_matches(w, '[td]ed$')) THEN 1 ELSE 0 END END))"""
GRADE = f"""CASE WHEN len(regexp_extract_all(plain, '{LETTERS}')) = 0 THEN 0 ELSE round(0.39::DOUBLE * len(regexp_extract_all(plain, '{LETTERS}')) / greatest(1, len(list_filter(regexp_extract_all(plain, '[^.!?]+'), lambda x: len(regexp_extract_all(x, '{LETTERS}')) > 2)))
    + 11.8::DOUBLE * {SYLLABLES} / len(regexp_extract_all(plain, '{LETTERS}')) - 15.59::DOUBLE, 2) END"""


@query(rf"""WITH m AS (SELECT doc_id, {MARKDOWN} AS t FROM documents), s AS (SELECT doc_id, t, {STRIP.format(t="t")} AS plain, list_filter(regexp_split_to_array(t, '(?m)^#{{1,3}}\s+'), lambda x: NOT regexp_matches(x, '^\s*$')) AS parts FROM m),
c AS (SELECT doc_id, {COUNT.format(t="plain")} AS words, list_transform(CASE WHEN len(parts) > 0 THEN parts ELSE [t] END, lambda p: {COUNT.format(t=STRIP.format(t="p"))}) AS n,
    len(list_distinct(regexp_extract_all(t, '\[\d+\]'))) + len(list_distinct(regexp_extract_all(t, '\([A-Z][a-z]+ et al\.?,? \d{{4}}\)'))) AS citations, {GRADE} AS grade FROM s)
SELECT doc_id, CAST(words AS INTEGER) AS words, CAST(len(n) AS INTEGER) AS sections, CAST(citations AS INTEGER) AS citations, round(1000.0::DOUBLE * citations / words, 4) AS per_1000, round(list_avg(n), 2) AS avg_section,
    round(CASE WHEN len(n) > 1 AND list_avg(n) > 0 THEN sqrt(list_sum(list_transform(n, lambda x: (x - list_avg(n)) * (x - list_avg(n)))) / (len(n) - 1)) / list_avg(n) ELSE 0 END, 4) AS cv_section, grade FROM c""")
def structural_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, sections and citations of markdown texts."""
    year = (10 + F.col("doc_id") % 2).cast("string")
    made = F.concat(F.lit("# **"), "source", F.lit("**\n"), F.replace("text", F.lit("\n"), F.lit("\n## ")), F.lit(" [1] [2] ["), (F.col("doc_id") % 3).cast("string"), F.lit("] (Smith et al., 20"), year, F.lit(") see [link](http://x) `code`"))
    docs = table(spark, sf_dir, "documents").select("doc_id", made.alias("t"))
    return docs.select("doc_id", metrics.structure(F.col("t")).alias("m")).select("doc_id", "m.*")


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 4 <> 3 AS parsed FROM events""")
def json_extract_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in replies: plain, fenced, in prose after a thought, and none."""
    props = F.col("props")
    fenced = F.concat(F.lit("Here:\n```json\n"), props, F.lit("\n```\ndone"))
    prose = F.concat(F.lit("<think>{no}</think>The answer is "), props, F.lit(" as asked."))
    reply = F.when(F.col("event_id") % 4 == 0, props).when(F.col("event_id") % 4 == 1, fenced).when(F.col("event_id") % 4 == 2, prose).otherwise("nothing {here")
    found = text.json_in_text(reply)
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(found, "$.k").cast("long").alias("k"), found.isNotNull().alias("parsed"))


AUTHORS = "list_transform(range(p_size % 24), lambda i: 'Author ' || i)"


@query(f"""WITH p AS (SELECT p_partkey, {AUTHORS} AS a, CASE WHEN p_partkey % 5 <> 0 THEN 1990 + p_size END AS y, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS j, CASE WHEN p_partkey % 4 <> 0 THEN '10.1/' || p_partkey END AS doi, p_name FROM part)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY coalesce(a[1], ''), coalesce(y, 0), p_partkey) AS INTEGER) AS number,
    CASE len(a) WHEN 0 THEN 'Unknown' WHEN 1 THEN a[1] WHEN 2 THEN a[1] || ' & ' || a[2] ELSE CASE WHEN len(a) <= 20 THEN array_to_string(a[:-2], ', ') || ', & ' || a[-1] ELSE array_to_string(a[:19], ', ') || ', ... ' || a[-1] END END
        || coalesce(' (' || y || ').', ' (n.d.).') || ' ' || p_name || '.' || coalesce(' *' || j || '*.', '') || coalesce(' https://doi.org/' || doi, '') AS apa,
    array_to_string(a[:6], ', ') || CASE WHEN len(a) > 6 THEN ', et al' ELSE '' END || '.' || coalesce(' ' || y || '.', '.') || ' ' || p_name || '.' || coalesce(' ' || j || '.', '') || coalesce(' doi:' || doi, '') AS vancouver,
    array_to_string(a[:6], '; ') || CASE WHEN len(a) > 6 THEN '; et al.' ELSE '' END || '. ' || p_name || '.' || coalesce(' *' || j || '*', '') || coalesce(' **' || y || '**.', '.') || coalesce(' DOI: ' || doi, '') AS acs FROM p""")
def bibliography_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered entries in three styles."""
    n = F.col("p_size") % 24
    authors = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.lit("Author "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", authors.alias("a"), F.when(F.col("p_partkey") % 5 != 0, 1990 + F.col("p_size")).alias("y"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("j"), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string"))).alias("doi")
    )
    order = Window.partitionBy(F.col("p_partkey") % 50).orderBy(F.coalesce(F.get("a", F.lit(0)), F.lit("")), F.coalesce("y", F.lit(0)), "p_partkey")
    lines = {s: bibliography.entry(s, F.col("a"), F.col("y"), F.col("p_name"), F.col("j"), F.col("doi")) for s in ("apa", "vancouver", "acs")}
    return part.select("p_partkey", F.row_number().over(order).alias("number"), *(c.alias(s) for s, c in lines.items()))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 50) END AS gated, startswith(md5(text), '1') OR startswith(md5(text), 'a0') AS routed FROM documents".replace("startswith", "starts_with"))
def text_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length gates and prefix routing."""
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") > 100, F.substring("text", 1, 50)).alias("gated"), F.md5("text").rlike("^(1|a0)").alias("routed"))


@query(r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '\&'), '%', '\%'), '$', '\$'), '#', '\#'), '_', '\_'), '{', '\{'), '}', '\}'), '~', '\textasciitilde{}'), '^', '\^{}')) AS escaped FROM documents""")
def latex_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts escaped for LaTeX."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.escape_latex(F.col("text"))).alias("escaped"))


@query("""SELECT doc_id, md5('{"id":"' || doc_id || '","source_database":"' || source || '","year":' || (2000 + n_chars % 25) || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"abstract_md5":"' || md5(text) || '"}') AS record FROM documents""")
def papers_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paper as a JSON record."""
    record = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_database"), (2000 + F.col("n_chars") % 25).alias("year"), "lang", "n_chars", F.md5("text").alias("abstract_md5"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.to_json(record)).alias("record"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS openalex, 'T' || doc_id AS title, 'j' || source AS journal, '10.1/' || md5(text) AS doi, md5(array_to_string(regexp_split_to_array(lang || ' ' || source || ' ' || lang, ' '), ' ')) AS abstract, CAST(2000 + doc_id % 20 AS INTEGER) AS year FROM documents""")
def openalex_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index records parsed, with their abstracts rebuilt."""
    inverted = F.create_map("lang", F.array(F.lit(0), F.lit(2)), "source", F.array(F.lit(1)))
    work = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("https://doi.org/10.1/"), F.md5("text")).alias("doi"), (2000 + F.col("doc_id") % 20).alias("publication_year"),
        F.struct(F.struct(F.concat(F.lit("j"), "source").alias("display_name")).alias("source")).alias("primary_location"), inverted.alias("abstract_inverted_index"),
    )
    found = records.openalex(table(spark, sf_dir, "documents").select(F.to_json(work).alias("json")))
    return found.select(F.col("external_ids")["openalex"].alias("openalex"), "title", "journal", "doi", F.md5("abstract").alias("abstract"), "year")


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text nodes of pages outside scripts, styles and page furniture."""
    return table(spark, sf_dir, "pages").select("page_id", markup.extractor("html")("html").alias("text"))


NL = "' || chr(10) || '"
HEADED = sections.HEADING.replace("'", "''")
DROPS = " OR ".join(f"contains(low, '{p}') OR contains('{p}', low)" for p in sections.DROPPED)
mark = lambda cut: "'" + cut.replace("\n", NL) + "'"


@query(rf"""WITH m AS (SELECT doc_id, '1. Introduction{NL}' || text || '{NL}2. Methods{NL}' || text || '{NL}Results{NL}' || text || '{NL}References{NL}' || text AS t FROM documents),
l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS no FROM (SELECT doc_id, string_split(t, chr(10)) AS p FROM m)),
h AS (SELECT *, regexp_matches(line, '{HEADED}') AND length(trim(line)) <= 80 AS heading FROM l),
s AS (SELECT *, CASE WHEN count_if(heading) OVER (PARTITION BY doc_id) < 2 THEN 0 ELSE count_if(heading) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) END AS section FROM h),
g AS (SELECT doc_id, section, CASE WHEN section > 0 THEN trim(lower(trim(regexp_extract(arg_min(line, no), '{HEADED}', 1)))) END AS low, string_agg(line, chr(10) ORDER BY no) AS body FROM s GROUP BY doc_id, section),
i AS (SELECT doc_id, section, low, CASE WHEN contains(low, 'introduction') AND length(body) > 3000 THEN left(body, 3000) || {mark(sections.CUT_INTRO)} ELSE body END AS body FROM g),
k AS (SELECT doc_id, section, CASE WHEN contains(low, 'method') AND length(body) > 2000 THEN left(body, 2000) || {mark(sections.CUT_METHODS)} ELSE body END AS body FROM i WHERE CASE WHEN section > 0 THEN NOT ({DROPS}) ELSE trim(body) <> '' END),
j AS (SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY section), '') AS kept FROM m LEFT JOIN k USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(kept) <= 8000 THEN kept ELSE left(kept, 2666) || {mark(sections.CUT)} || right(kept, 5334) END AS text FROM j""")
def section_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers cut with regard to their sections."""
    made = F.concat(F.lit("1. Introduction\n"), "text", F.lit("\n2. Methods\n"), "text", F.lit("\nResults\n"), "text", F.lit("\nReferences\n"), "text")
    return sections.truncate(table(spark, sf_dir, "documents").select("doc_id", made.alias("text")), 8000)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS calls, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY ALL")
def stream_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily token counts from the audit log as a stream."""
    events = table(spark, sf_dir, "events")
    found = audit.drain(audit.token_windows(audit.audit_stream(spark, events, f"{sf_dir}/events*.parquet")), shared_folder(spark), mode="complete")
    latest = found.filter(F.col("batch") == found.agg(F.max("batch")).first()[0])
    return latest.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "calls", "tokens")
