"""Computations over ordered rows: convergence, budgets, numbering, continuation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions.text import citation_markers
from scholium.session import materialise


def convergence(scores: DataFrame, target: str, cycle: str, score: str, threshold: float, most: int, delta: float) -> DataFrame:
    """First cycle at which revision of each target stops, and why.

    In this order: the number of cycles, the threshold, too small a gain. The
    scores stay doubles. A target that goes on has no row.
    """
    order = Window.partitionBy(target).orderBy(cycle)
    n, gain = F.row_number().over(order), F.col(score) - F.lag(score).over(order)
    why = F.when(n >= most, "max_iterations").when(F.col(score) >= threshold, "threshold").when((n >= 2) & (gain < delta), "converged")
    stops = scores.withColumn("reason", why).withColumn("iterations", n).filter(F.col("reason").isNotNull())
    first = stops.groupBy(target).agg(F.min(F.struct(F.col(cycle).alias("cycle"), "iterations", F.col(score).alias("score"), "reason")).alias("s"))
    return first.select(target, F.col("s.cycle").alias("stop_cycle"), "s.iterations", "s.score", "s.reason")


def budget_crossing(usage: DataFrame, group: str, order: list[str], tokens: str, budget: int | None) -> DataFrame:
    """The first row of each group at which its running total is over the budget; none without a budget."""
    if not budget:
        return usage.withColumn("running", F.lit(0).cast("long")).limit(0)
    w = Window.partitionBy(group).orderBy(*order)
    running = usage.withColumn("running", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("running") > budget)
    return running.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def parts_in_order(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``rows``, dealt into ranges of ``order`` (nulls first) and written, with _part: the number of the range."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def part_offsets(dealt: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """_part, with the number of rows (_place) and the sums of the values (_sum_<value>) of all parts before it, and its own (_rows, _own_<value>).

    One row for each part, so one task may add them up and the result is broadcast.
    """
    own = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), *(F.coalesce(F.sum(v), F.lit(0)).alias(f"_own_{v}") for v in values))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return own.select("_part", "_rows", *(f"_own_{v}" for v in values), zero("_rows").alias("_place"), *(zero(f"_own_{v}").alias(f"_sum_{v}") for v in values))


def placed(rows: DataFrame, order: list[str], values: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """``rows`` with place (from 0, by ``order`` over all rows, nulls first) and running_<value>: the sum of each value up to and with the row.

    A distributed prefix sum: the rows are dealt into ranges of the order, each
    range is summed, and every row gets what lies before it in its range and the
    sums of the ranges before. No task holds more than one range. Null values
    count as 0; rows that are equal in ``order`` get different places in any
    order. Values should be whole numbers, as sums of floats depend on the ranges.
    """
    dealt = parts_in_order(rows, order, parts)
    within = Window.partitionBy("_part").orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    sums = [(F.col(f"_sum_{v}") + F.sum(F.coalesce(v, F.lit(0))).over(so_far)).alias(f"running_{v}") for v in values]
    return dealt.join(F.broadcast(part_offsets(dealt, values)), "_part").select(*rows.columns, (F.col("_place") + F.row_number().over(within) - 1).alias("place"), *sums)


def first_over(usage: DataFrame, order: list[str], tokens: str, budget: int | None, parts: int | None = None) -> DataFrame:
    """The first row of all at which the running total of ``tokens`` is over the budget, with place and running; none without a budget, or if it is never over.

    Tokens are not negative, so only the range in which the total passes the
    budget is put in order.
    """
    if not budget:
        return usage.withColumns({"place": F.lit(0).cast("long"), "running": F.lit(0).cast("long")}).limit(0)
    dealt = parts_in_order(usage, order, parts)
    offsets = part_offsets(dealt, (tokens,)).filter((F.col(f"_sum_{tokens}") <= budget) & (F.col(f"_sum_{tokens}") + F.col(f"_own_{tokens}") > budget))
    within = Window.partitionBy("_part").orderBy(*order)
    running = F.col(f"_sum_{tokens}") + F.sum(F.coalesce(tokens, F.lit(0))).over(within.rowsBetween(Window.unboundedPreceding, 0))
    found = dealt.join(F.broadcast(offsets), "_part").select(*usage.columns, (F.col("_place") + F.row_number().over(within) - 1).alias("place"), running.alias("running"))
    return found.filter(F.col("running") > budget).orderBy("place").limit(1)


def temporal_split(papers: DataFrame, theme: str, year: str = "year", least: int = 4, span: int = 3) -> DataFrame:
    """Early and late papers of each theme, split at the middle year; themes with too few papers or years have no row."""
    ends = papers.filter(F.col(year).isNotNull()).groupBy(theme).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & (F.col("last_year") - F.col("first_year") >= span))
    middle = F.col("first_year") + F.floor((F.col("last_year") - F.col("first_year")) / 2)
    late = papers.join(ends.withColumn("middle", middle), theme).filter(F.col(year).isNotNull())
    return late.groupBy(theme, "first_year", "last_year", "n").agg(F.count_if(F.col(year) <= F.col("middle")).alias("n_early"), F.count_if(F.col(year) > F.col("middle")).alias("n_late"))


def citation_numbers(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """Number of each cited id in a document, by first appearance, and its mentions."""
    marks = texts.select(doc, F.posexplode(citation_markers(F.col(text))).alias("at", "cited"))
    first = marks.groupBy(doc, "cited").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("mentions"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(doc).orderBy("first_at")))


def continued_lines(lines: DataFrame, doc: str, no: str, line: str, start: str, skip: str | None = None) -> DataFrame:
    """Entries of each document: a line that matches ``start`` begins one, the others go on with it; lines before the first are dropped, and those that match ``skip`` and begin none."""
    if skip:
        lines = lines.filter(F.col(line).rlike(start) | ~F.col(line).rlike(skip))
    order = Window.partitionBy(doc).orderBy(no)
    marked = lines.withColumn("entry", F.count_if(F.col(line).rlike(start)).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("entry > 0")
    parts = F.array_sort(F.collect_list(F.struct(F.col(no).alias("no"), F.trim(F.col(line)).alias("part"))))
    return marked.groupBy(doc, "entry").agg(F.array_join(F.transform(parts, lambda p: p["part"]), " ").alias("text"), F.count(F.lit(1)).alias("n_lines"))


def batches(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """Adds batch: the number of the block of ``size`` rows, in order, within the group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(place / size))


def all_batches(rows: DataFrame, order: list[str], size: int, parts: int | None = None) -> DataFrame:
    """``rows`` with batch: the number of the block of ``size`` rows, in order over all rows; only the last batch may be smaller."""
    found = placed(rows, order, parts=parts)
    return found.select(*rows.columns, F.floor(F.col("place") / size).alias("batch"))
