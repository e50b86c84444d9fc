"""Reviews evaluated against reference reviews, all of them in one pass, and their reports.

Citations, structure, topics and the judges' scores are each taken over all
reviews at once and meet in one row for each review; statistics over all of them
and by group are grouping sets of those rows, and a report is an expression of
its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.operators.matching import match_citations
from scholium.operators.metrics import grouped_stats, structure

# fixed values: how much each part weighs, and how many missed papers a report names
WEIGHTS = {"citation": 0.25, "synthesis": 0.30, "topic": 0.25, "writing": 0.20}
NAMED = 10


def evaluate(reviews: DataFrame, generated: DataFrame, reference: DataFrame, topics: DataFrame, scores: DataFrame) -> DataFrame:
    """A row for each review: citations, structure, topics, synthesis, writing and overall.

    reviews: review (unique), text (markdown) and columns to group by, which pass
    through; generated, reference: review, id, ref (bibliography entries); topics:
    review, topic, in_generated, in_reference; scores: review, part ('synthesis'
    or 'writing'), generated, reference (0 to 5) and dimensions (a map), at most
    one a part. What a review lacks counts as the reference counts a failed part:
    no scores are zeros, no topics are a coverage of 0 against 1.
    """
    cited = match_citations(generated, reference)
    cited = cited.select("review", F.struct(*(c for c in cited.columns if c != "review")).alias("citations"))
    listed = lambda keep: F.array_sort(F.collect_set(F.when(keep, F.col("topic"))))
    gen, ref = F.coalesce("in_generated", F.lit(False)), F.coalesce("in_reference", F.lit(False))
    found = topics.groupBy("review").agg(listed(gen & ref).alias("both"), listed(ref & ~gen).alias("only_reference"), listed(gen & ~ref).alias("only_generated"))
    share = F.coalesce(F.try_divide(F.size("both"), F.size("both") + F.size("only_reference")), F.lit(0.0))
    found = found.select("review", F.struct(share.alias("coverage"), "both", "only_reference", "only_generated").alias("topics"))
    part = lambda name: F.max(F.when(F.col("part") == name, F.struct("generated", "reference", (F.col("generated") - F.col("reference")).alias("delta"), F.array_sort(F.map_entries("dimensions")).alias("dimensions")))).alias(name)
    judged = scores.groupBy("review").agg(part("synthesis"), part("writing"))
    whole = reviews.join(cited, "review", "left").join(found, "review", "left").join(judged, "review", "left").withColumn("structure", structure(F.col("text"))).drop("text")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = {"citation": zero(F.col("citations.recall")), "synthesis": zero(F.col("synthesis.generated")) / 5, "topic": zero(F.col("topics.coverage")), "writing": zero(F.col("writing.generated")) / 5}
    terms = [F.lit(w) * parts[k] for k, w in WEIGHTS.items()]
    return whole.withColumn("overall", F.round(terms[0] + terms[1] + terms[2] + terms[3], 4))


def summary(results: DataFrame, *keys: str) -> DataFrame:
    """measure, and mean, std, low, high and n of all reviews and by each key alone, of overall, recall and coverage."""
    measures = {"overall": F.col("overall"), "recall": F.col("citations.recall"), "coverage": F.col("topics.coverage")}
    pairs = F.explode(F.create_map(*(x for name, c in measures.items() for x in (F.lit(name), F.coalesce(c, F.lit(0.0))))))
    rows = results.select(*keys, pairs.alias("measure", "value"))
    found = None
    for name in measures:
        one = grouped_stats(rows.filter(F.col("measure") == name), "value", *keys).withColumn("measure", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


def report(stamp: Column) -> Column:
    """The markdown report of a row of ``evaluate``: scores, missed papers, topics and dimensions."""
    line = lambda pattern, *parts: F.format_string(pattern, *parts)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    table = lambda head: F.concat(F.lit(f"| {head} |\n|"), F.lit("---|" * (head.count("|") + 1)))
    coverage = F.lit(1.0)
    missed = F.filter(F.split(F.coalesce("citations.missed", F.lit("")), "\n"), lambda m: m != "")
    bullets = F.array_join(F.transform(F.slice(missed, 1, NAMED), lambda m: F.concat(F.lit("- "), m)), "\n")
    beyond = F.when(F.size(missed) > NAMED, line("- ... and %d more", F.size(missed) - NAMED))
    dimensions = lambda c: F.array_join(F.transform(F.coalesce(F.col(f"{c}.dimensions"), F.array().cast("array<struct<key:string,value:double>>")), lambda d: line("| %s | %.1f | — |", F.initcap(F.replace(d["key"], F.lit("_"), F.lit(" "))), d["value"])), "\n")
    topics = lambda c: F.array_join(F.coalesce(F.col(f"topics.{c}"), F.array().cast("array<string>")), ", ")
    some = lambda text, c: F.when(c != "", F.concat(F.lit(text), c))
    said = lambda c: F.when(c == "", "none").otherwise(c)
    blocks = [
        F.lit("# Evaluation of a review"),
        F.concat(F.lit("**Generated:** "), stamp, F.lit("\n**Review:** `"), F.col("review").cast("string"), F.lit("`")),
        F.lit("## Scores"),
        F.concat_ws(
            "\n", table("Dimension | Generated | Reference | Delta"), line("| Citation Recall | %.2f | — | — |", zero("citations.recall")), line("| Synthesis Depth | %.1f/5 | %.1f/5 | %+.2f |", zero("synthesis.generated"), zero("synthesis.reference"), zero("synthesis.delta")),
            line("| Topical Coverage | %.2f | %.2f | %+.2f |", zero("topics.coverage"), coverage, zero("topics.coverage") - coverage), line("| Writing Quality | %.1f/5 | %.1f/5 | %+.2f |", zero("writing.generated"), zero("writing.reference"), zero("writing.delta")), line("| **Overall** | **%.2f** | — | — |", F.col("overall")),
        ),
        F.lit("## Citations"),
        F.concat_ws("\n", line("- **Recall:** %.1f%% (%d/%d reference papers matched)", 100 * zero("citations.recall"), count("citations.matched_count"), count("citations.reference_count")), line("- **Generated bibliography size:** %d papers", count("citations.generated_count"))),
        some("**Missed papers:**\n", F.concat_ws("\n", F.when(F.size(missed) > 0, bullets), beyond)),
        F.lit("## Synthesis"),
        F.concat_ws("\n", table("Dimension | Generated | Reference"), some("", dimensions("synthesis"))),
        F.lit("## Topics"),
        F.concat_ws("\n", line("- **Coverage:** %.1f%% of reference topics", 100 * zero("topics.coverage")), F.concat(F.lit("- **In both:** "), said(topics("both"))), some("- **Only in reference:** ", topics("only_reference")), some("- **Only in generated:** ", topics("only_generated"))),
        F.lit("## Writing"),
        F.concat_ws("\n", table("Dimension | Generated | Reference"), some("", dimensions("writing"))),
    ]
    return F.concat_ws("\n\n", *blocks)
