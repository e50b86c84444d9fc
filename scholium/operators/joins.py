"""Joins: array overlap, ranges, neighbours, and similarity."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scholium.functions.text import match_tokens
from scholium.operators.themes import containing

__all__ = ["containing", "in_band", "indel", "indel_ratio", "neighbours", "overlapping", "paired", "token_jaccard"]
#: Pairs that a task makes, about.
TASK_PAIRS = 20_000_000


def overlapping(left: DataFrame, right: DataFrame, left_key: str, right_key: str, member: str) -> DataFrame:
    """Pairs of keys that share a member, from two (key, member) tables: an equi join, never a comparison of arrays."""
    return left.select(left_key, member).distinct().join(right.select(right_key, member).distinct(), member).select(left_key, right_key).distinct()


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of rows of equal key, where few keys have many rows on both sides.

    The pairs are counted first. What the sides hold is small beside them, so the
    rows of a key are dealt: every row of the left side to all parts of its key,
    each of the right side to one, and the parts to as many tasks as the pairs
    take. Keys are not brought together again.
    """
    of = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias(name))
    met = of(left, "_n").join(of(right, "_m"), key).agg(F.sum(F.col("_n") * F.col("_m")).alias("pairs"), F.count(F.lit(1)).alias("keys")).first()
    tasks = math.ceil((met.pairs or 0) / TASK_PAIRS)
    if tasks <= 1:
        return left.join(right, key)
    parts = math.ceil(4 * tasks / met["keys"])
    dealt = left.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, key, "_part")
    held = right.withColumn("_part", F.pmod(F.xxhash64(*right.columns), F.lit(parts)).cast("int")).repartition(tasks, key, "_part")
    return dealt.join(held, [key, "_part"]).drop("_part")


def in_band(rows: DataFrame, anchors: list[tuple[float, float, str]], score: str) -> DataFrame:
    """Adds the label of the first anchor whose band holds the score, and the next anchor's; null in the gaps.

    The anchors are a fixed short list, so the range join is a CASE.
    """
    inside = lambda a: F.col(score).between(a[0], a[1])
    after = [*(a[2] for a in anchors[1:]), None]
    label = reduce(lambda c, a: c.when(inside(a), F.lit(a[2])), anchors[1:], F.when(inside(anchors[0]), F.lit(anchors[0][2])))
    pairs = list(zip(anchors, after, strict=True))
    following = reduce(lambda c, p: c.when(inside(p[0]), F.lit(p[1])), pairs[1:], F.when(inside(pairs[0][0]), F.lit(pairs[0][1])))
    return rows.withColumn("anchor", label).withColumn("next_anchor", following)


def neighbours(rows: DataFrame, group: str, pos: str, text: str, tail: int) -> DataFrame:
    """Adds the end of the text before, and the positions before and after."""
    order = Window.partitionBy(group).orderBy(pos)
    before = F.lag(text).over(order)
    return rows.withColumns({"before": F.substring(before, -tail, tail), "prev_pos": F.lag(pos).over(order), "next_pos": F.lead(pos).over(order)})


def token_jaccard(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of titles with a token Jaccard of ``threshold`` or more.

    Both sides are (id, title). Only the rarest tokens of each title enter the
    inverted index: with n tokens, n - ceil(threshold * n) + 1 of them, which
    any pair over the threshold must share.
    """
    tokens = lambda df: df.select("id", F.array_distinct(match_tokens(F.col("title"))).alias("tokens")).filter(F.size("tokens") > 0)
    a, b = tokens(left), tokens(right)
    seen = a.select(F.explode("tokens").alias("token")).unionAll(b.select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))

    def prefixed(df: DataFrame) -> DataFrame:
        rare = Window.partitionBy("id").orderBy("n", "token")
        exploded = df.select("id", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(seen, "token").withColumn("place", F.row_number().over(rare))
        return exploded.filter(F.col("place") <= F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1).select("id", "token")

    met = prefixed(a).withColumnRenamed("id", "left_id").join(prefixed(b).withColumnRenamed("id", "right_id"), "token").select("left_id", "right_id").distinct()
    full = met.join(a.select(F.col("id").alias("left_id"), F.col("tokens").alias("x")), "left_id").join(b.select(F.col("id").alias("right_id"), F.col("tokens").alias("y")), "right_id")
    score = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return full.select("left_id", "right_id", score.alias("score")).filter(F.col("score") >= threshold)


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b); 100 for two empty texts."""
    if not a and not b:
        return 100.0
    # bit-parallel longest common subsequence
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        both = row & masks.get(c, 0)
        row = ((row + both) | (row - both)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])
