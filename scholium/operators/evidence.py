"""The evidence map: everything that is known of a theme in one row, by one shuffle.

Findings, contradictions, dated papers and gaps come as tables of their own. They
are laid one below the other, each row with its kind, and grouped once by theme:
lists in a fixed order, counts of strengths, and the middle year that parts a
theme's early papers from its late ones are all taken within that grouping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions.text import bound

# fixed values: the strengths of findings, and the least papers and years that make a progression
STRENGTHS = ("strong", "moderate", "weak", "preliminary")
LEAST_PAPERS, LEAST_SPAN = 4, 3


def _listed(kind: str, order: tuple[str, ...], *fields: str) -> Column:
    """The rows of a kind as a list, by ``order``; equal rows in one order are side by side."""
    row = F.struct(*order, *(f for f in fields if f not in order))
    return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, row)))


def _progression(years: Column) -> Column:
    """First and last year, and how many papers lie up to and after the middle; null for few papers or years."""
    first, last = F.array_min(years), F.array_max(years)
    middle = first + F.floor((last - first) / 2)
    early = bound(middle, lambda m: F.size(F.filter(years, lambda y: y <= m)))
    found = F.struct(first.alias("first_year"), last.alias("last_year"), early.alias("n_early"), (F.size(years) - early).alias("n_late"))
    return F.when((F.size(years) >= LEAST_PAPERS) & (last - first >= LEAST_SPAN), found)


def evidence_map(themes: DataFrame, findings: DataFrame, contradictions: DataFrame, papers: DataFrame, gaps: DataFrame) -> DataFrame:
    """A row for each theme with its name, findings, strengths, contradictions, papers, progression and gaps.

    themes: theme, name (each theme once); findings: theme, paper, pos, claim,
    strength; contradictions: theme, left, right, text; papers: theme, paper,
    year; gaps: theme, topic, severity, coverage. Rows of themes that are not
    listed, or of none, are left out; a theme without rows has empty lists and no
    progression. A paper counts once however often it is listed; papers without a
    year are listed and take no part in the progression. ``strengths`` counts the
    findings of each strength, others under 'other'; ``severity`` is 'major' if a
    gap is, else 'minor', null without gaps. A theme's row holds all of its rows.
    """
    tagged = [("theme", themes), ("finding", findings), ("contradiction", contradictions), ("paper", papers), ("gap", gaps)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (t.withColumn("kind", F.lit(k)) for k, t in tagged))
    of = lambda k: F.col("kind") == k
    strength = F.when(F.col("strength").isin(*STRENGTHS), F.col("strength")).otherwise("other")
    counts = F.struct(*(F.count_if(of("finding") & (strength == s)).alias(s) for s in (*STRENGTHS, "other")))
    dated = F.array_sort(F.collect_set(F.when(of("paper"), F.struct("paper", "year"))))
    grouped = rows.groupBy("theme").agg(
        F.max(F.when(of("theme"), F.struct("name"))).alias("own"),
        _listed("finding", ("paper", "pos", "claim", "strength")).alias("findings"), counts.alias("strengths"),
        _listed("contradiction", ("left", "right", "text")).alias("contradictions"), dated.alias("papers"),
        _listed("gap", ("topic", "severity", "coverage")).alias("gaps"),
    )
    years = F.filter(F.transform("papers", lambda p: p["year"]), lambda y: y.isNotNull())
    severity = F.when(F.exists("gaps", lambda g: g["severity"] == "major"), "major").when(F.size("gaps") > 0, "minor")
    found = grouped.filter(F.col("own").isNotNull()).withColumns({"progression": bound(years, _progression), "severity": severity})
    return found.select("theme", "own.name", "findings", "strengths", "contradictions", "papers", "progression", "gaps", "severity")


def section_bundles(sections: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each section with the evidence of its themes, in the order in which it names them.

    sections: section, themes (a list). Themes without evidence are left out, a
    section without any has an empty bundle.
    """
    named = sections.select("section", F.posexplode("themes").alias("place", "theme"))
    given = evidence.select("theme", F.struct("theme", *(c for c in evidence.columns if c != "theme")).alias("evidence"))
    bundled = named.join(given, "theme").groupBy("section").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("evidence")))), lambda b: b["evidence"]).alias("bundle"))
    found = sections.select("section").join(bundled, "section", "left")
    return found.withColumn("bundle", F.coalesce("bundle", F.array().cast(bundled.schema["bundle"].dataType)))
