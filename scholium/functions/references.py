"""Reference lines: DOIs, titles, records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholium.functions.text import bound, word_count

NUMBERED = r"^\[\d+\]\s+\S|^\d+\.\s+[A-Z]"
CAPTION = r"(?i)^(figure|table|appendix|footnote)"
HEADER = r"(?im)^#{1,3}\s*(?:references|bibliography)"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def after_header(markdown: Column) -> Column:
    """What follows the first heading of references; null without one."""
    return F.get(F.split(markdown, HEADER, 2), F.lit(1))


def matched_doi(ref: Column) -> Column:
    """The DOI by which references are matched: lower case, without closing punctuation; null without one."""
    found = F.regexp_extract(ref, r"10\.\d{4,}/\S+", 0)
    return F.when(found != "", F.regexp_replace(F.lower(found), r"[.,;)]+$", ""))


def listed_doi(ref: Column) -> Column:
    """The DOI of a reference's record; null without one."""
    found = F.regexp_extract(F.regexp_replace(ref, r"https?://(?:dx\.)?doi\.org/", ""), r"10\.\d{4,9}/[^\s,;)\]]+", 0)
    return F.when(found != "", F.regexp_replace(found, r"[.,;)]+$", ""))


def second_part(ref: Column) -> Column:
    """The part after the authors' full stop, the number gone; the whole where there is none."""
    bare = F.regexp_replace(ref, r"^\[?\d+[\]\.]\s*", "")
    return F.coalesce(F.get(F.split(bare, r"\.\s+", 3), F.lit(1)), bare)


def likely_title(ref: Column) -> Column:
    """The first part after the authors that has three words, or else the fourth; of two or three short parts the second.

    Without parts it is the first 200 characters; a blank line gives ''.
    """
    bare = stripped(F.regexp_replace(ref, r"^\s*(?:\[\d+\]|\d+\.)\s*", ""))
    clean = lambda s: F.regexp_replace(stripped(s), r"\.+$", "")

    def of(parts: Column) -> Column:
        rest = F.slice(parts, 2, 1 << 20)
        picked = F.get(F.filter(rest, lambda s, i: (word_count(s) >= 3) | (i >= 2)), F.lit(0))
        return F.when(F.size(parts) < 2, F.substring(F.get(parts, F.lit(0)), 1, 200)).otherwise(clean(F.coalesce(picked, F.get(rest, F.lit(0)))))

    return bound(F.split(bare, r"\. "), of)
