"""Cited answers, key lookups and benchmark reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions.references import stripped
from scholium.functions.text import slug_title, url_year

CITED = r"\[(\d+)\]"
# fixed value: a year in a text
TEXT_YEAR = r"(?:^|[\s,(])(\d{4})(?=[)\s,.\-;]|$)"


def contexts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, idx and context: the first sentence with words that cites the number idx, its markers taken out."""
    said = texts.select(key, F.posexplode(F.split(text, r"(?<=[.!?])\s+")).alias("pos", "sentence"))
    clean = stripped(F.regexp_replace("sentence", CITED, ""))
    marks = said.select(key, "pos", clean.alias("clean"), F.explode(F.regexp_extract_all("sentence", F.lit(CITED), 1)).alias("ref")).filter("clean <> ''")
    return marks.groupBy(key, F.col("ref").cast("int").alias("idx")).agg(F.min_by("clean", "pos").alias("context"))


def papers(citations: DataFrame, context: DataFrame, key: str) -> DataFrame:
    """Cited URLs as papers: title from the slug (without one the row is dropped), DOI and year from the URL.

    citations: key, idx (from 1) and url. The context of the number is the
    abstract; its latest plausible year stands in for one in the URL.
    """
    years = F.transform(F.regexp_extract_all("context", F.lit(TEXT_YEAR), 1), lambda y: y.cast("int"))
    told = F.array_max(F.filter(years, lambda y: y.between(1900, 2030)))
    doi = F.regexp_extract("url", r"(?i)doi\.org/(10\.\d{4,9}/\S+)", 1)
    found = citations.withColumn("url", F.trim("url")).join(context, [key, "idx"], "left").withColumn("title", slug_title(F.col("url"))).filter("title IS NOT NULL")
    return found.withColumns({"doi": F.when(doi != "", F.regexp_replace(doi, r"\.+$", "")), "year": F.coalesce(url_year(F.col("url")), told), "abstract": F.col("context")})


def structured(citations: DataFrame, context: DataFrame, key: str) -> DataFrame:
    """Citation objects of answers as papers: key, idx, title, authors, year, doi, abstract and url.

    citations: key, idx (from 1) and citation, the JSON of an object with title,
    url, author or authors (a string with commas, or a list), published_date or
    year (a number or a text), doi, and snippet or abstract. What is absent or
    empty is taken from the URL (title from its slug, year, DOI) or from the
    context of the number (abstract). Citations that are no objects, or have no
    title in the end, give no row.
    """
    field = lambda name, kind="string": F.try_variant_get("c", f"$.{name}", kind)
    given = lambda *names: F.coalesce(*(F.when(field(n) != "", field(n)) for n in names))
    parsed = citations.withColumn("c", F.try_parse_json("citation")).filter(F.startswith(F.schema_of_variant("c"), F.lit("OBJECT"))).join(context, [key, "idx"], "left")
    url = F.coalesce(field("url"), F.lit(""))
    people = lambda name: F.coalesce(F.try_variant_get("c", f"$.{name}", "array<string>"), F.split(F.when(~F.startswith(F.schema_of_variant(F.try_variant_get("c", f"$.{name}", "variant")), F.lit("ARRAY")), field(name)), ","))
    listed = lambda name: F.filter(F.transform(people(name), stripped), lambda x: x != "")
    some = lambda name: F.when(F.size(listed(name)) > 0, listed(name))
    told = lambda text: F.array_max(F.filter(F.transform(F.regexp_extract_all(text, F.lit(TEXT_YEAR), 1), lambda y: y.cast("int")), lambda y: y.between(1900, 2030)))
    dated = given("published_date", "year")
    number = lambda name: F.when(F.schema_of_variant(F.try_variant_get("c", f"$.{name}", "variant")) == "BIGINT", field(name, "int"))
    year = F.coalesce(F.when(field("published_date").isNull() | (field("published_date") == ""), number("year")).otherwise(number("published_date")), told(dated), url_year(url))
    doi = F.regexp_extract(url, r"(?i)doi\.org/(10\.\d{4,9}/\S+)", 1)
    found = parsed.select(
        key, "idx", F.coalesce(given("title"), slug_title(F.when(url != "", url))).alias("title"), F.coalesce(some("author"), some("authors"), F.array().cast("array<string>")).alias("authors"), year.alias("year"),
        F.coalesce(given("doi"), F.when(doi != "", F.regexp_replace(doi, r"\.+$", ""))).alias("doi"), F.coalesce(given("snippet", "abstract"), F.col("context")).alias("abstract"), F.when(url != "", url).alias("url"),
    )
    return found.filter("title IS NOT NULL")


def located(rows: DataFrame, keys: DataFrame, places: DataFrame) -> DataFrame:
    """Papers with pmcid (their own, else by pmid), location (by DOI), and preprint addresses.

    rows: pmid, pmcid, doi, arxiv; keys: pmid, pmcid; places: doi, location,
    both with unique keys. A pmcid always starts with PMC in the result.
    """
    found = rows.join(keys.withColumnRenamed("pmcid", "_pmcid"), "pmid", "left").join(places, "doi", "left")
    key = F.coalesce("pmcid", "_pmcid")
    return found.withColumns({
        "pmcid": F.when(F.upper(key).startswith("PMC"), key).otherwise(F.concat(F.lit("PMC"), key)),
        "arxiv_url": F.concat(F.lit("https://arxiv.org/pdf/"), F.regexp_replace("arxiv", r"v\d+$", "")),
        "preprint_url": F.when(F.col("doi").startswith("10.1101/"), F.concat(F.lit("https://www.biorxiv.org/content/"), "doi", F.lit("v1.full.pdf"))),
    }).drop("_pmcid")


def best_review(results: DataFrame, topic: str, pos: str, first: int = 10) -> DataFrame:
    """The benchmark of each topic among its first results: the most cited review of 50 citations (tier 0), else the most cited paper of 100 (tier 1).

    results: topic, pos, cites, types. Of equal citations the earlier one; topics without any have no row.
    """
    head = results.withColumn("_n", F.row_number().over(Window.partitionBy(topic).orderBy(pos))).filter(F.col("_n") <= first)
    review = F.coalesce(F.arrays_overlap("types", F.array(F.lit("Review"), F.lit("Meta-Analysis"))), F.lit(False))
    tier = F.when((F.col("cites") >= 50) & review, 0).when(F.col("cites") >= 100, 1)
    place = F.row_number().over(Window.partitionBy(topic).orderBy("tier", F.desc("cites"), pos))
    return head.withColumn("tier", tier).filter("tier IS NOT NULL").withColumn("_n", place).filter("_n = 1").drop("_n")


def reference_dois(edges: DataFrame, paper: str, pos: str, most: int = 1000) -> DataFrame:
    """paper and dois: the DOIs of its first references, trimmed and in lower case; references without one count and go."""
    head = edges.withColumn("_n", F.row_number().over(Window.partitionBy(paper).orderBy(pos))).filter(F.col("_n") <= most)
    listed = F.array_sort(F.collect_list(F.when(F.col("doi") != "", F.struct("_n", F.trim(F.lower("doi")).alias("doi")))))
    return head.groupBy(paper).agg(F.transform(listed, lambda x: x["doi"]).alias("dois"))
