"""Search responses as rows: JSON records to candidate papers, in the JVM.

Each function takes a frame with a column of JSON text and gives the columns of
``PAPER``; records without a title, or that are no JSON, give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAPER = ("title", "authors", "year", "journal", "doi", "abstract", "source_database", "external_ids", "citation_count")


def _ids(**found: Column) -> Column:
    """Map of the ids that are there."""
    pairs = [x for k, c in found.items() for x in (F.lit(k), c)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.coalesce(v, F.lit("")) != "")


def _papers(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.filter(F.coalesce(columns["title"], F.lit("")) != "").select(*(columns[c].alias(c) for c in PAPER))


def openalex(rows: DataFrame, column: str = "json") -> DataFrame:
    """Works, with the abstract rebuilt from its inverted index (by place, then word)."""
    shape = (
        "id string, title string, publication_year int, doi string, cited_by_count int, ids struct<pmid:string>, authorships array<struct<author:struct<display_name:string>>>,"
        "primary_location struct<source:struct<display_name:string>>, abstract_inverted_index map<string,array<int>>"
    )
    w = F.col("w")
    names = F.filter(F.transform(w["authorships"], lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    places = F.flatten(F.transform(F.map_entries(w["abstract_inverted_index"]), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("place"), e["key"].alias("word")))))
    abstract = F.when(F.size(places) > 0, F.array_join(F.transform(F.array_sort(places), lambda p: p["word"]), " "))
    doi = F.when(F.startswith(w["doi"], F.lit("https://doi.org/")), F.substring(w["doi"], 17, 1000)).otherwise(w["doi"])
    pmid = F.when(F.startswith(w["ids"]["pmid"], F.lit("https://pubmed.ncbi.nlm.nih.gov/")), F.element_at(F.split(w["ids"]["pmid"], "/"), -1)).otherwise(w["ids"]["pmid"])
    return _papers(
        rows.withColumn("w", F.from_json(column, shape)),
        title=w["title"], authors=F.coalesce(names, F.array().cast("array<string>")), year=w["publication_year"], journal=w["primary_location"]["source"]["display_name"], doi=doi, abstract=abstract,
        source_database=F.lit("openalex"), external_ids=_ids(openalex=w["id"], pmid=pmid), citation_count=w["cited_by_count"],
    )


def semantic_scholar(rows: DataFrame, column: str = "json") -> DataFrame:
    shape = (
        "paperId string, title string, year int, abstract string, citationCount int, authors array<struct<name:string>>, externalIds struct<DOI:string,PubMed:string,ArXiv:string>, openAccessPdf struct<url:string>, journal struct<name:string>"
    )
    w = F.col("w")
    names = F.filter(F.transform(w["authors"], lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return _papers(
        rows.withColumn("w", F.from_json(column, shape)),
        title=w["title"], authors=F.coalesce(names, F.array().cast("array<string>")), year=w["year"], journal=w["journal"]["name"], doi=w["externalIds"]["DOI"], abstract=w["abstract"],
        source_database=F.lit("semantic_scholar"), external_ids=_ids(pmid=w["externalIds"]["PubMed"], arxiv=w["externalIds"]["ArXiv"], s2_id=w["paperId"], s2_pdf_url=w["openAccessPdf"]["url"]), citation_count=w["citationCount"],
    )


def pubmed(rows: DataFrame, column: str = "json") -> DataFrame:
    """Articles; typed ids are objects with a type and a value."""
    typed = "array<struct<type:string,value:string>>"
    shape = (
        f"MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,AuthorList:array<struct<LastName:string,ForeName:string>>,Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string>>>,Abstract:struct<AbstractText:array<string>>,ELocationID:{typed}>>,"
        f"PubmedData struct<ArticleIdList:{typed}>"
    )
    m = F.col("w")["MedlineCitation"]
    a, listed = m["Article"], F.col("w")["PubmedData"]["ArticleIdList"]
    named = F.filter(a["AuthorList"], lambda x: F.coalesce(x["LastName"], F.lit("")) != "")
    names = F.transform(named, lambda x: F.trim(F.concat_ws(" ", x["LastName"], x["ForeName"])))
    of = lambda ids, kind: F.get(F.filter(ids, lambda i: i["type"] == kind), F.lit(0))["value"]
    located = of(a["ELocationID"], "doi")
    texts = a["Abstract"]["AbstractText"]
    return _papers(
        rows.withColumn("w", F.from_json(column, shape)),
        title=a["ArticleTitle"], authors=F.coalesce(names, F.array().cast("array<string>")), year=a["Journal"]["JournalIssue"]["PubDate"]["Year"].try_cast("int"), journal=a["Journal"]["Title"],
        doi=F.when(F.coalesce(located, F.lit("")) != "", located).otherwise(of(listed, "doi")), abstract=F.when(F.size(texts) > 0, F.array_join(texts, " ")), source_database=F.lit("pubmed"), external_ids=_ids(pmid=m["PMID"], pmcid=of(listed, "pmc")), citation_count=F.lit(None).cast("int"),
    )


def shown(papers: DataFrame) -> Column:
    """The JSON record of a paper that a search tool hands over: six fields, absent ones as null."""
    given = lambda c, kind: F.col(c) if c in papers.columns else F.lit(None).cast(kind)
    fields = (("title", "title", "string"), ("authors", "authors", "array<string>"), ("year", "year", "int"), ("doi", "doi", "string"), ("abstract", "abstract", "string"), ("source_database", "source", "string"))
    return F.to_json(F.struct(*(given(c, kind).alias(name) for c, name, kind in fields)), {"ignoreNullFields": "false"})


def first_success(**attempts: Column) -> tuple[Column, Column]:
    """Text and name of the first attempt with more than 100 characters, cut at 200,000."""
    usable = {k: F.when(F.length(c) > 100, F.substring(c, 1, 200_000)) for k, c in attempts.items()}
    return F.coalesce(*usable.values()), F.coalesce(*(F.when(c.isNotNull(), F.lit(k)) for k, c in usable.items()))
