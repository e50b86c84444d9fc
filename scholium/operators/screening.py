"""Multi-source search and screening as rounds over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.operators.dedup import merge_papers, union_sources, year_range
from scholium.operators.ordered import placed
from scholium.operators.rounds import screened_with_promotions


def multi_source_search(sources: list[DataFrame], low: int | None = None, high: int | None = None) -> DataFrame:
    """One row for each paper that the sources found within the years, merged in the order of the sources and, within each, of rank.

    Each source has rank, title, doi, year and source_database, and what else
    ``merge_papers`` fills. Sources that found nothing add nothing.
    """
    found = placed(year_range(union_sources(sources), low, high), ["source_pos", "rank", "title", "doi"])
    return merge_papers(found, "place")


def first_seen(rows: DataFrame, key: str, order: list[str], most: int | None = None) -> DataFrame:
    """key and place of the different keys by first appearance in ``order`` (nulls first), the first ``most`` of them; rows without a key go."""
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("_at"))
    if most is not None:
        return first.orderBy("_at", key).limit(most).select(key)
    return first.select(key)


def top_cited(candidates: DataFrame, group: list[str], first: int = 10) -> DataFrame:
    """The ``first`` most cited candidates of each group that have an id, the earlier of equals; a missing count is 0. Adds seed, their place from 1.

    candidates: the columns of ``group``, pos, s2_id and citation_count.
    """
    order = Window.partitionBy(*group).orderBy(F.desc(F.coalesce("citation_count", F.lit(0))), "pos")
    return candidates.filter(F.coalesce("s2_id", F.lit("")) != "").withColumn("seed", F.row_number().over(order)).filter(F.col("seed") <= first)


def model_for(score: Column, high: tuple[int, ...] = (4, 5), moderate: tuple[int, ...] = (3,), names: tuple[str, str] = ("large", "small"), enabled: bool = True) -> Column:
    """The model that a paper's score calls for: the larger one for high and unexpected scores, null where tiers are off."""
    if not enabled:
        return F.lit(None).cast("string")
    return F.when(F.coalesce(score.isin(*high), F.lit(False)), names[0]).when(F.coalesce(score.isin(*moderate), F.lit(False)), names[1]).otherwise(names[0])


def decided(papers: DataFrame, decisions: DataFrame, order: list[str], size: int = 20) -> DataFrame:
    """Papers with the score of their batch and index, clamped to 1 to 5; decisions outside a batch, and papers without one, count for nothing.

    papers are put in batches of ``size`` over all of them, in ``order``;
    decisions: batch, index (from 0) and score, of repeats the last one by ``pos``.
    """
    numbered = placed(papers, order)
    at = numbered.select(*papers.columns, F.floor(F.col("place") / size).alias("batch"), (F.col("place") % size).alias("index"))
    said = decisions.filter((F.col("index") >= 0) & (F.col("index") < size)).groupBy("batch", "index").agg(F.max_by("score", "pos").alias("score"))
    return at.join(said, ["batch", "index"]).withColumn("score", F.least(F.lit(5), F.greatest(F.lit(1), F.col("score"))))


def token_totals(audit: DataFrame, usage: str = "token_usage") -> DataFrame:
    """input_tokens and output_tokens of an audit log whose usage is a map; other keys do not count, nor absent maps."""
    total = lambda k: F.coalesce(F.sum(F.try_element_at(usage, F.lit(k))), F.lit(0)).cast("long").alias(k)
    return audit.agg(total("input_tokens"), total("output_tokens"))


def screen(papers: DataFrame, decisions: DataFrame, second: DataFrame, order: list[str], threshold: int = 3, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """The screening stage: the papers that are in (score, promoted), and a row on how it went.

    Decisions come by batch and index. A paper one under the threshold is in if a
    second decision (the key of ``order``, score) lifts it. The row counts
    candidates, those in, those promoted and those without an abstract, with the
    share rejected; status is 'warning' if over 0.8 are rejected, fewer than 10 are
    in, or over half have no abstract. papers: the columns of ``order``, abstract.
    """
    key = order[0]
    chosen = screened_with_promotions(decided(papers, decisions, order, size), second, key, threshold)
    counts = papers.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.coalesce("abstract", F.lit("")) == "").alias("no_abstract"))
    included = chosen.agg(F.count(F.lit(1)).alias("included"), F.count_if("promoted").alias("promoted"))
    share = lambda a: F.coalesce(F.try_divide(a, F.col("candidates")), F.lit(0.0))
    rejected = F.when(F.col("candidates") > 0, 1.0 - share(F.col("included"))).otherwise(0.0)
    # one row each
    row = counts.join(F.broadcast(included)).withColumn("rejection_rate", F.round(rejected, 4))
    bad = (rejected > 0.8) | (F.col("included") < 10) | (share(F.col("no_abstract")) > 0.5)
    return chosen, row.withColumn("status", F.when(bad, "warning").otherwise("passed"))
