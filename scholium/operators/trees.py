"""Dependency levels, reachability and outlines: one join a level, each level written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholium.session import materialise


def _levels(first: DataFrame, step, most: int | None = None) -> DataFrame:
    """The rows of ``first`` and of each step from the level before, until a level is empty."""
    found = [materialise(first)]
    while not found[-1].isEmpty():
        if most is not None and len(found) > most:
            raise ValueError("the graph has a cycle")
        found.append(materialise(step(found[-1])))
    return reduce(DataFrame.unionByName, found)


def dag_levels(edges: DataFrame) -> DataFrame:
    """Level of each node: 0 without a dependency, else one more than its highest.

    edges: node, dep (null for none). A node is in a level once, however many
    paths lead there. A cycle is an error.
    """
    pairs = materialise(edges.select("node", "dep").distinct())
    nodes = pairs.select("node").distinct().count()
    roots = pairs.groupBy("node").agg(F.count("dep").alias("n")).filter("n = 0").select("node", F.lit(0).alias("level"))
    step = lambda level: level.join(pairs.withColumnRenamed("node", "next"), F.col("dep") == F.col("node")).select(F.col("next").alias("node"), (F.col("level") + 1).alias("level")).distinct()
    found = _levels(roots, step, nodes)
    levels = found.groupBy("node").agg(F.max("level").alias("level"))
    if levels.count() < nodes:
        raise ValueError("the graph has a cycle")
    return levels


def downstream(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes that depend on those of ``start`` (node), these included, with the least number of steps."""
    pairs = materialise(edges.select("node", "dep").filter(F.col("dep").isNotNull()).distinct())
    seen = materialise(start.select("node", F.lit(0).alias("depth")).distinct())
    last = seen
    while not last.isEmpty():
        after = last.join(pairs.withColumnRenamed("node", "next"), F.col("dep") == F.col("node")).select(F.col("next").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        last = materialise(after.join(seen.select("node"), "node", "left_anti"))
        seen = seen.unionByName(last)
    return seen


def outline(sections: DataFrame) -> DataFrame:
    """Pre-order place and depth of each section of a document's tree, to any depth.

    sections: doc, section, parent (null at the top), pos among its siblings.
    """
    rows = materialise(sections.select("doc", "section", "parent", F.lpad(F.col("pos").cast("string"), 6, "0").alias("step")))
    top = rows.filter(F.col("parent").isNull()).select("doc", "section", F.col("step").alias("path"), F.lit(1).alias("depth"))
    below = rows.select("doc", F.col("section").alias("child"), "parent", "step")

    def step(level: DataFrame) -> DataFrame:
        met = level.withColumnRenamed("section", "parent").join(below, ["doc", "parent"])
        return met.select("doc", F.col("child").alias("section"), F.concat_ws(".", "path", "step").alias("path"), (F.col("depth") + 1).alias("depth"))

    found = _levels(top, step)
    return found.select("doc", "section", "depth", F.row_number().over(Window.partitionBy("doc").orderBy("path")).alias("place"))


def find_section(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, section, depth and place of the sections asked for (doc, section): the first in reading order, where an id repeats."""
    met = outline(sections).join(wanted.select("doc", "section").distinct(), ["doc", "section"], "left_semi")
    return met.groupBy("doc", "section").agg(F.min(F.struct("place", "depth")).alias("f")).select("doc", "section", "f.depth", "f.place")


def assemble(documents: DataFrame, sections: DataFrame, drafts: DataFrame) -> DataFrame:
    """doc and draft: the title, then each section's heading (one mark deeper than its depth) and text, in outline order.

    documents: doc, title; sections: as for ``outline``, with title; drafts:
    doc, section, text. A section without a draft has a heading only if one
    straight below it has a draft.
    """
    above = sections.join(drafts.select("doc", "section"), ["doc", "section"], "left_semi").select("doc", F.col("parent").alias("section"), F.lit(True).alias("leads")).filter("section IS NOT NULL").distinct()
    rows = outline(sections).join(sections.select("doc", "section", "title"), ["doc", "section"]).join(drafts, ["doc", "section"], "left").join(above, ["doc", "section"], "left")
    heading = F.concat(F.repeat(F.lit("#"), F.col("depth") + 1), F.lit(" "), "title")
    part = F.when(F.col("text") != "", F.concat(heading, F.lit("\n\n"), "text")).when(F.col("text").isNotNull() | F.col("leads"), heading)
    parts = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("place", part.alias("part")))))
    bodies = rows.groupBy("doc").agg(F.transform(parts, lambda p: p["part"]).alias("parts"))
    whole = F.concat(F.array(F.concat(F.lit("# "), "title", F.lit("\n"))), F.coalesce("parts", F.array().cast("array<string>")))
    return documents.join(bodies, "doc", "left").select("doc", F.array_join(whole, "\n\n").alias("draft"))
