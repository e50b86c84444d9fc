"""Bibliography entries in the APA, Vancouver and ACS styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def author_list(authors: Column, style: str) -> Column:
    """Authors joined as the style asks; '' for none."""
    n = F.size(authors)
    if style == "apa":
        last = F.element_at(authors, F.when(n > 0, -1))
        many = F.concat(F.array_join(F.slice(authors, 1, 19), ", "), F.lit(", ... "), last)
        some = F.concat(F.array_join(F.slice(authors, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", & "), last)
        two = F.concat(F.get(authors, F.lit(0)), F.lit(" & "), last)
        return F.when(n == 0, "Unknown").when(n == 1, F.get(authors, F.lit(0))).when(n == 2, two).when(n <= 20, some).otherwise(many)
    joiner = "; " if style == "acs" else ", "
    more = "; et al." if style == "acs" else ", et al"
    return F.when(n > 6, F.concat(F.array_join(F.slice(authors, 1, 6), joiner), F.lit(more))).otherwise(F.array_join(authors, joiner))


def entry(style: str, authors: Column, year: Column, title: Column, journal: Column, doi: Column) -> Column:
    """One line of a bibliography; parts that are missing leave no gap. A missing year is n.d. in APA only."""
    there = lambda c, before, after="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    names, named = author_list(authors, style), F.concat(F.lit(" "), title, F.lit("."))
    dated = lambda before, after, none: F.when(year.isNotNull() & (year != 0), F.concat(F.lit(before), year.cast("string"), F.lit(after))).otherwise(none)
    if style == "apa":
        return F.concat(names, dated(" (", ").", " (n.d.)."), named, there(journal, " *", "*."), there(doi, " https://doi.org/"))
    if style == "vancouver":
        return F.concat(names, F.lit("."), dated(" ", ".", "."), named, there(journal, " ", "."), there(doi, " doi:"))
    return F.concat(names, F.lit("."), named, there(journal, " *", "*"), dated(" **", "**.", "."), there(doi, " DOI: "))


def bibtex_key(paper_id: Column) -> Column:
    """Key of an entry: the first twelve characters of the id."""
    return F.substring(paper_id, 1, 12)
