"""Rounds that add papers to a corpus: gates, new papers, promotions, remedies, assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.operators.dedup import only_new, snowball
from scholium.operators.ordered import placed
from scholium.session import materialise, reread


def append_absent(existing: DataFrame, new: DataFrame, group: str, value: str) -> DataFrame:
    """existing and the new values that their group does not have; repeats among the new ones stay, groups that do not exist get none."""
    groups = existing.select(group).distinct()
    fresh = new.join(groups, group, "left_semi").join(existing.select(group, value).distinct(), [group, value], "left_anti")
    return existing.select(group, value).unionByName(fresh.select(group, value))


def appended(existing: Column, new: Column) -> Column:
    """A list with the new members that it does not have, each once, in order."""
    return F.concat(existing, F.array_except(new, existing))


def preferred(screened: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """All screened papers, and the candidates that were not screened."""
    return screened.unionByName(candidates.join(screened.select(key).distinct(), key, "left_anti"))


def screened_with_promotions(decisions: DataFrame, second: DataFrame, key: str, threshold: int = 3) -> DataFrame:
    """Papers that pass, and borderline ones (one below) that pass the second screening; adds promoted.

    decisions and second: key, score, clamped to 1 to 5 here. Without a second
    decision a borderline paper stays out.
    """
    clamp = lambda c: F.least(F.lit(5), F.greatest(F.lit(1), c))
    first = decisions.withColumn("score", clamp(F.col("score")))
    passed = first.filter(F.col("score") >= threshold).withColumn("promoted", F.lit(False))
    again = second.select(key, clamp(F.col("score")).alias("score")).filter(F.col("score") >= threshold)
    line = first.filter(F.col("score") == threshold - 1).drop("score").join(again, key)
    return passed.unionByName(line.withColumn("promoted", F.lit(True)))


def gap_round(gaps: DataFrame, found: DataFrame, corpus: DataFrame, topic: str, threshold: float = 0.75) -> DataFrame:
    """The corpus with what a round of gap searches adds; adds added.

    gaps: topic, severity, coverage and queries (a list), a row for each gap. A
    topic is searched, with the queries of all its gaps, if one of them is
    major or its coverage is under the threshold. found: topic, query, id, doi;
    corpus: topic, id, doi. Papers whose DOI the topic has are dropped, those
    without one stay; a paper that two queries find comes once for each.
    """
    gate = gaps.groupBy(topic).agg(F.max((F.col("severity") == "major").cast("int")).alias("major"), F.min("coverage").alias("coverage")).filter((F.col("major") == 1) | (F.col("coverage") < threshold))
    asked = gaps.join(gate.select(topic), topic, "left_semi").select(topic, F.explode("queries").alias("query")).distinct()
    hits = found.join(asked, [topic, "query"], "left_semi")
    key = F.when(F.trim("doi") != "", F.concat_ws("|", F.col(topic).cast("string"), F.lower(F.trim("doi"))))
    fresh = only_new(hits.withColumn("_doi", key), corpus.withColumn("_doi", key), "_doi")
    return corpus.select(topic, "id", "doi", F.lit(False).alias("added")).unionByName(fresh.select(topic, "id", "doi", F.lit(True).alias("added")))


def enrichment(sections: DataFrame, found: DataFrame, key: str, most: int = 15, threshold: int = 2, first: int = 5) -> DataFrame:
    """The first papers that pass, in screening order, for each section that has fewer than ``most``.

    sections: key, n_papers; found: key, pos, id, score.
    """
    thin = sections.filter(F.col("n_papers") < most).select(key)
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return found.filter(F.col("score") >= threshold).join(thin, key, "left_semi").withColumn("place", place).filter(F.col("place") <= first)


def capped(actions: DataFrame, group: str, action: str, order: list, caps: dict[str, int]) -> DataFrame:
    """Adds round (from 1) and executed: whether the action's cap leaves it; actions without a cap are never executed."""
    limit = F.coalesce(F.create_map(*(F.lit(x) for pair in caps.items() for x in pair))[F.col(action)], F.lit(0))
    number = F.row_number().over(Window.partitionBy(group, action).orderBy(*order))
    return actions.withColumn("round", number).withColumn("executed", number <= limit)


def coverage(assessments: DataFrame, check: str, topic: str, covered: str) -> DataFrame:
    """Covered, total and the uncovered topics of each check, in order, and whether to expand its queries."""
    missing = F.array_sort(F.collect_list(F.when(~F.coalesce(F.col(covered), F.lit(False)), F.col(topic))))
    found = assessments.groupBy(check).agg(F.count_if(covered).alias("covered"), F.count(F.lit(1)).alias("total"), missing.alias("uncovered"))
    return found.withColumn("status", F.when(F.size("uncovered") > 0, "warning").otherwise("passed"))


def chain_links(chains: DataFrame, findings: DataFrame, years: DataFrame) -> DataFrame:
    """The first finding of each paper of a chain, in chain order; papers without one have no link.

    chains: chain, papers (a list); findings: paper, pos, claim, strength; years: paper, year.
    """
    first = findings.groupBy("paper").agg(F.min(F.struct("pos", "claim", "strength")).alias("f")).select("paper", "f.claim", "f.strength")
    links = chains.select("chain", F.posexplode("papers").alias("place", "paper"))
    return links.join(first, "paper").join(years, "paper", "left").select("chain", "place", "paper", "claim", "strength", "year")


def edge_lines(themes: DataFrame, edges: DataFrame) -> DataFrame:
    """theme and lines: its relations one a line in order, or a remark that there are none.

    edges: theme, pos, source, target, kind, description.
    """
    line = F.concat(F.lit("- [@"), F.col("source").cast("string"), F.lit("] → [@"), F.col("target").cast("string"), F.lit("] ("), "kind", F.lit("): "), "description")
    made = edges.groupBy("theme").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return themes.join(made, "theme", "left").withColumn("lines", F.coalesce("lines", F.lit("(No explicit relationships recorded)")))


def directives(sections: DataFrame, configured: DataFrame, key: str, pos: str) -> DataFrame:
    """Sections with the directive of their id, the last one where several have it; none where no one has."""
    last = configured.groupBy(key).agg(F.max_by("directive", pos).alias("directive"))
    return sections.join(last, key, "left")


def expansion_round(sections: DataFrame, found: DataFrame, corpus: DataFrame, review: str) -> DataFrame:
    """Sections with the new papers of an expansion: every section that asked gets all new papers of its review.

    sections: review, section, asked, papers (a list); found: review, pos, id,
    doi; corpus: review, doi. Papers whose DOI the review has are dropped,
    those without one stay. The papers are listed once for each review, in the
    order found, and a section takes those that it does not have.
    """
    key = F.when(F.trim("doi") != "", F.concat_ws("|", F.col(review).cast("string"), F.lower(F.trim("doi"))))
    fresh = only_new(found.withColumn("_doi", key), corpus.withColumn("_doi", key), "_doi")
    first = fresh.groupBy(review, "id").agg(F.min("pos").alias("pos"))
    new = first.groupBy(review).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("_new"))
    whole = F.when(F.col("asked") & F.col("_new").isNotNull(), appended(F.col("papers"), F.col("_new"))).otherwise(F.col("papers"))
    return sections.join(new, review, "left").withColumn("papers", whole).drop("_new")


def citation_frontier(passages: DataFrame, edges: DataFrame, hops: int = 2, first: int = 10) -> DataFrame:
    """Papers that the citations of each passage lead to: passage, hop (from 1), rank and paper.

    passages: passage, paper (what it cites); edges: paper, cited. Each hop takes
    the papers that those of the hop before cite (at first those of the passage),
    without any that the passage cites or an earlier hop found, and keeps the
    ``first`` most cited of them, the smaller id first. Every hop is written;
    the work of a hop is that of its frontier, not of the graph's paths.
    """
    links = edges.select("paper", "cited").filter("paper IS NOT NULL AND cited IS NOT NULL").distinct()
    weight = links.groupBy("cited").agg(F.count(F.lit(1)).alias("weight"))
    seen = [materialise(passages.select("passage", "paper", F.lit(0).alias("hop"), F.lit(0).alias("rank")).distinct())]
    best = Window.partitionBy("passage").orderBy(F.desc("weight"), "cited")
    for hop in range(1, hops + 1):
        reached = seen[-1].select("passage", "paper").join(links, "paper").select("passage", "cited").distinct()
        fresh = reached.join(reread(seen).select("passage", F.col("paper").alias("cited")), ["passage", "cited"], "left_anti")
        ranked = fresh.join(weight, "cited").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= first)
        seen.append(materialise(ranked.select("passage", F.col("cited").alias("paper"), F.lit(hop).alias("hop"), "rank")))
    return reread(seen).filter("hop > 0").select("passage", "hop", "rank", "paper")


def passage_search(passages: DataFrame, edges: DataFrame, papers: DataFrame, known: DataFrame, hops: int = 2, first: int = 10) -> DataFrame:
    """New papers for passages: what their citations lead to, without known DOIs and without what an earlier passage brought.

    passages: passage, paper; edges: paper, cited; papers: paper, doi, title;
    known: doi. The papers of all passages, by passage, hop and rank, go through
    one snowball; papers without a DOI are never known. Gives passage, hop, rank,
    paper and place (its number in that order, from 0).
    """
    found = citation_frontier(passages, edges, hops, first).join(papers.select("paper", "doi", "title"), "paper")
    order = placed(only_new(found, known, "doi"), ["passage", "hop", "rank"])
    return snowball(order, "place").select("passage", "hop", "rank", "paper", "place")
