"""Remedies that act: checks prescribe them, caps bound them, tables change.

The state is a few tables with a row for each query, candidate and screened paper
of a review. A round runs every check on the state, applies each prescribed
remedy that its cap still allows, to all reviews at once, and writes the new
state; rounds follow until no remedy is carried out. The caps bound the rounds,
whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.session import materialise, release, reread

# fixed values: the remedies, in the order in which a round carries them out, and how often each may run
CAPS = {"expand_queries": 2, "lower_screening_threshold": 1, "retry_gap_search": 2}
MAX_REJECTION = 0.8


@dataclass(frozen=True)
class State:
    """queries (review, db, query), candidates (review, paper, score, topic), screened (review, paper, topic, how)."""

    queries: DataFrame
    candidates: DataFrame
    screened: DataFrame


@dataclass(frozen=True)
class World:
    """What a run can learn: suggestions (review, topic, db, query), topics (review, topic, query: a query that covers it), offers (review, query, paper, score, topic), gaps (review, topic, severity, needed).

    Scores are from 1 to 5; ``threshold`` is what screening asks for.
    """

    suggestions: DataFrame
    topics: DataFrame
    offers: DataFrame
    gaps: DataFrame
    threshold: int = 3


def uncovered(state: State, world: World) -> DataFrame:
    """review and topic of the topics that no query covers."""
    covered = world.topics.join(state.queries.select("review", "query").distinct(), ["review", "query"], "left_semi").select("review", "topic").distinct()
    return world.topics.select("review", "topic").distinct().join(covered, ["review", "topic"], "left_anti")


def rejected(state: State) -> DataFrame:
    """review, and the share of its candidates that were not screened in; only reviews with candidates."""
    there = state.candidates.groupBy("review").agg(F.count(F.lit(1)).alias("n"))
    kept = state.screened.groupBy("review").agg(F.count(F.lit(1)).alias("k"))
    return there.join(kept, "review", "left").select("review", (1.0 - F.coalesce("k", F.lit(0)) / F.col("n")).alias("rate"))


def open_gaps(state: State, world: World) -> DataFrame:
    """review and topic of the major gaps with fewer screened papers than needed."""
    have = state.screened.groupBy("review", "topic").agg(F.count(F.lit(1)).alias("k"))
    return world.gaps.filter("severity = 'major'").join(have, ["review", "topic"], "left").filter(F.coalesce("k", F.lit(0)) < F.col("needed")).select("review", "topic")


def _expand(state: State, world: World, topics: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Suggested queries for the uncovered topics, for the databases that a review asks, if it does not have them."""
    asked = state.queries.select("review", "db").distinct()
    new = materialise(world.suggestions.join(topics, ["review", "topic"], "left_semi").select("review", "db", "query").distinct().join(asked, ["review", "db"], "left_semi").join(state.queries, ["review", "db", "query"], "left_anti"))
    return {"queries": state.queries.unionByName(new)}, new


def _lower(state: State, world: World, reviews: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Candidates that were left out and reach the threshold less one are screened in."""
    low = world.threshold - 1
    out = state.candidates.join(reviews, "review", "left_semi").join(state.screened.select("review", "paper"), ["review", "paper"], "left_anti")
    new = materialise(out.filter(F.lit(low >= 1) & (F.col("score") >= low)).select("review", "paper", "topic", F.lit("lowered").alias("how")))
    return {"screened": state.screened.unionByName(new)}, new


def _retry(state: State, world: World, topics: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Papers that suggested queries for the open gaps bring, once a review and only such as are no candidates, and those of them that pass."""
    queries = world.suggestions.join(topics, ["review", "topic"], "left_semi").select("review", "query").distinct()
    found = world.offers.join(queries, ["review", "query"], "left_semi").groupBy("review", "paper").agg(F.min(F.struct("score", "topic")).alias("p")).select("review", "paper", "p.*")
    fresh = materialise(found.join(state.candidates.select("review", "paper"), ["review", "paper"], "left_anti"))
    new = fresh.filter(F.col("score") >= world.threshold).select("review", "paper", "topic", F.lit("gap").alias("how"))
    return {"candidates": state.candidates.unionByName(fresh), "screened": state.screened.unionByName(new)}, new


def remedy(state: State, world: World, caps: dict[str, int] = CAPS) -> tuple[State, DataFrame]:
    """The state when no remedy is left to carry out, and its audit: round (from 1), review, action, cause and changed.

    Each round takes the actions in the order of ``CAPS``, each on what the one
    before left: topics that no query covers expand the queries, a share of
    rejected candidates over 0.8 lowers the threshold, major gaps retry the search.
    An action of a review counts against its cap whether it changes anything or
    not; actions without a cap are never carried out. Candidates and screened
    papers are unique by review and paper; rows without a review take no part.
    """
    causes_of = {"expand_queries": uncovered, "lower_screening_threshold": lambda s, _: rejected(s).filter(F.col("rate") > MAX_REJECTION), "retry_gap_search": open_gaps}
    acts = {"expand_queries": _expand, "lower_screening_threshold": _lower, "retry_gap_search": _retry}
    frames = {n: materialise(getattr(state, n)) for n in ("queries", "candidates", "screened")}
    audits: list[DataFrame] = []
    number = 0
    while True:
        number += 1
        acted = False
        for action, act in acts.items():
            causes = causes_of[action](State(**frames), world)
            if audits:
                # a few written rows for each review and round
                done = reread(audits).filter(F.col("action") == action).groupBy("review").agg(F.count(F.lit(1)).alias("n"))
                causes = causes.join(done.filter(F.col("n") >= caps.get(action, 0)), "review", "left_anti")
            elif not caps.get(action):
                continue
            causes = materialise(causes)
            if not caps.get(action) or causes.isEmpty():
                release(causes)
                continue
            changed, new = act(State(**frames), world, causes)
            before, frames = frames, frames | {n: materialise(df) for n, df in changed.items()}
            counts = new.groupBy("review").agg(F.count(F.lit(1)).alias("changed"))
            row = causes.groupBy("review").agg(F.count(F.lit(1)).alias("cause")).join(counts, "review", "left")
            audits.append(materialise(row.select(F.lit(number).alias("round"), "review", F.lit(action).alias("action"), "cause", F.coalesce("changed", F.lit(0)).cast("long").alias("changed"))))
            release(causes, *(before[n] for n in changed))
            acted = True
        # what no round changed no later round changes
        if not acted:
            break
    none = frames["candidates"].limit(0).select(F.lit(0).alias("round"), "review", F.lit("").alias("action"), F.lit(0).cast("long").alias("cause"), F.lit(0).cast("long").alias("changed"))
    return State(**frames), reread(audits) if audits else none
