"""Drafts for output: markers resolved by style, LaTeX bodies and entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions.bibliography import bibtex_key
from scholium.functions.text import bound, citation_markers, escape_latex
from scholium.operators.ordered import citation_numbers

MARKER = r"\[@[^\]]+\]"


def resolve_markers(texts: DataFrame, papers: DataFrame, doc: str, text: str, style: str = "apa") -> DataFrame:
    """doc and text with every [@id] replaced by its number or, but for Vancouver, by the first author's first word and the year.

    papers: id, authors, year. Papers that are unknown or have no author keep
    their number in every style; a missing year is n.d.
    """
    numbered = citation_numbers(texts, doc, text)
    known = papers.select(F.col("id").alias("cited"), F.regexp_extract(F.get("authors", F.lit(0)), r"\S+", 0).alias("name"), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")).alias("when"))
    number = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("]"))
    named = F.concat(F.lit("("), "name", F.lit(", "), "when", F.lit(")"))
    label = number if style == "vancouver" else F.when(F.col("name") != "", named).otherwise(number)
    labels = numbered.join(known, "cited", "left").groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("cited", label.alias("label")))).alias("labels"))
    gaps = F.split(text, MARKER, -1)
    piece = lambda g: F.transform(citation_markers(F.col(text)), lambda x, i: F.concat(F.get(g, i), F.element_at("labels", x)))
    whole = bound(gaps, lambda g: F.concat(F.array_join(piece(g), ""), F.element_at(g, -1)))
    return texts.join(labels, doc, "left").select(doc, whole.alias(text))


def latex_cites(text: Column) -> Column:
    """Markers as cite commands with the keys of the entries."""
    return F.regexp_replace(text, r"\[@([^\]]{1,12})[^\]]*\]", r"\\cite{$1}")


def latex_body(markdown: Column) -> Column:
    """Markdown headings of levels one to four as LaTeX sections, their titles escaped; other lines as they are."""

    def line(x: Column) -> Column:
        made = lambda command, marks: F.concat(F.lit(f"\\{command}{{"), escape_latex(F.substring(x, marks + 2, 1 << 30)), F.lit("}"))
        starts = lambda marks: F.startswith(x, F.lit("#" * marks + " "))
        return F.when(starts(1), made("section", 1)).when(starts(2), made("section", 2)).when(starts(3), made("subsection", 3)).when(starts(4), made("subsubsection", 4)).otherwise(x)

    return F.array_join(F.transform(F.split(markdown, "\n"), line), "\n")


def bibtex(paper_id: Column, authors: Column, title: Column, journal: Column, year: Column, doi: Column) -> Column:
    """A BibTeX article; no author is Unknown, no year 0, other missing parts are empty."""
    names = F.when(F.size(authors) > 0, F.array_join(authors, " and ")).otherwise("Unknown")
    empty = lambda c: F.coalesce(c, F.lit(""))
    parts = (("author", names), ("title", escape_latex(title)), ("journal", escape_latex(empty(journal))), ("year", F.coalesce(year, F.lit(0)).cast("string")), ("doi", empty(doi)))
    lines = [F.concat(F.lit(f"  {name} = {{"), c, F.lit("}")) for name, c in parts]
    return F.concat(F.lit("@article{"), bibtex_key(paper_id), F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))
