"""Citations of sections and drafts, checked against what is known and what was assigned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions.text import citation_markers


def _split(marked: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """valid and invalid: the different ids cited, by whether they are known, sorted."""
    cited = marked.select(*keys, F.explode(F.array_distinct("markers")).alias("id"))
    on = ["id", *(k for k in keys if k in known.columns)]
    found = cited.join(known.select(*on, F.lit(True).alias("known")).distinct(), on, "left")
    return found.groupBy(*keys).agg(*(F.array_sort(F.collect_list(F.when(hit, F.col("id")))).alias(name) for name, hit in (("valid", F.col("known").isNotNull()), ("invalid", F.col("known").isNull()))))


def _report(marked: DataFrame, split: DataFrame, keys: list[str], uncited: Column) -> DataFrame:
    empty = F.array().cast("array<string>")
    found = marked.join(split, keys, "left").withColumns({c: F.coalesce(c, empty) for c in ("valid", "invalid")})
    return found.select(*keys, "valid", "invalid", uncited.alias("uncited"), F.size("markers").cast("long").alias("markers"), F.size(F.array_distinct("markers")).cast("long").alias("unique_markers"))


def validate_sections(sections: DataFrame, known: DataFrame, keys: list[str], text: str = "text", assigned: str = "assigned") -> DataFrame:
    """A report for every section: valid, invalid and uncited ids (sorted lists), and its markers, all and different ones.

    sections: ``keys`` (unique), text with [@id] markers, and the ids assigned to
    it (a list, repeats stay in the report); known: id. Sections without a marker
    or with a null text cite nothing, so all that was assigned is uncited; a null
    list assigns nothing.
    """
    marked = sections.select(*keys, citation_markers(F.coalesce(text, F.lit(""))).alias("markers"), F.coalesce(assigned, F.array().cast("array<string>")).alias("assigned"))
    uncited = F.array_sort(F.filter("assigned", lambda x: ~F.array_contains("markers", x)))
    return _report(marked, _split(marked, known, keys), keys, uncited)


def validate_drafts(drafts: DataFrame, known: DataFrame, review: str, text: str = "text") -> DataFrame:
    """The same for whole drafts: uncited is every known paper of the review that its draft never cites.

    drafts: review (unique), text; known: review, id.
    """
    marked = drafts.select(review, citation_markers(F.coalesce(text, F.lit(""))).alias("markers"))
    cited = marked.select(review, F.explode(F.array_distinct("markers")).alias("id"))
    left = known.select(review, "id").distinct().join(cited, [review, "id"], "left_anti").groupBy(review).agg(F.array_sort(F.collect_list("id")).alias("left"))
    with_left = marked.join(left, review, "left")
    return _report(with_left, _split(marked, known, [review]), [review], F.coalesce("left", F.array().cast("array<string>")))


def issues(reports: DataFrame, location: str) -> DataFrame:
    """A row for each fault: an unknown id is critical, an assigned paper without a citation major."""
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    fault = lambda severity, text, fix: F.struct(F.lit(severity).alias("severity"), text.alias("description"), fix.alias("suggested_fix"))
    critical = F.transform("invalid", lambda i: fault("critical", line("[@", i, "] cites a paper that is not in the corpus"), line("remove [@", i, "] or cite a paper of the corpus")))
    major = F.transform("uncited", lambda i: fault("major", line("[@", i, "] was assigned and is not cited"), line("cite [@", i, "] or take it off the section")))
    rows = reports.select(F.coalesce(F.col(location).cast("string"), F.lit("unknown")).alias("location"), F.explode(F.concat(critical, major)).alias("i"))
    return rows.select("location", "i.*")
