"""Union, deduplication and merging of records from several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions.text import doi_key, missing, title_key
from scholium.session import materialise, release, reread


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All rows of the sources with source_pos (their order); absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.withColumn("source_pos", F.lit(i)) for i, s in enumerate(sources)))


def year_range(papers: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Rows of the years asked for, ends included; with a bound, null years go."""
    if low is not None:
        papers = papers.filter(F.col("year") >= low)
    return papers.filter(F.col("year") <= high) if high is not None else papers


def parse_year_range(text: str | None) -> tuple[int | None, int | None]:
    """'2015-2020', '-2020', '2015-' or nothing, as bounds."""
    text = (text or "").strip()
    if not text:
        return None, None
    low, dash, high = text.partition("-")
    if not dash or text == "-" or any(x and not x.isdigit() for x in (low, high)):
        raise ValueError(f"not a range of years: {text!r}")
    bounds = (int(low) if low else None, int(high) if high else None)
    if None not in bounds and bounds[0] > bounds[1]:
        raise ValueError(f"years in reverse: {text!r}")
    return bounds


def merge_papers(papers: DataFrame, pos: str = "pos", fill: tuple[str, ...] = ("abstract", "year", "journal", "doi", "citation_count")) -> DataFrame:
    """One row for each paper, merged in arrival order.

    Rows with a DOI group by it. Rows without one group by title, unless a DOI
    row has that title: then they are discarded. The first row of a group gives
    title and source; the columns in ``fill`` take their first value that is
    not null, authors their first list that is not empty, and external_ids are
    united, the earliest row winning; columns that are absent are left out. Adds
    n_merged.
    """
    keyed = papers.withColumns({"doi": doi_key(F.col("doi")), "title_key": title_key(F.col("title"))})
    with_doi, without = keyed.filter(~missing(F.col("doi"))), keyed.filter(missing(F.col("doi")))

    def merged(rows: DataFrame, key: str) -> DataFrame:
        first = [F.min_by(c, pos).alias(c) for c in ("title", "source_database")]
        filled = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(pos))).alias(c) for c in fill if c in papers.columns]
        if "authors" in papers.columns:
            filled.append(F.coalesce(F.min_by("authors", F.when(F.size("authors") > 0, F.col(pos))), F.min_by("authors", pos)).alias("authors"))
        found = rows.groupBy(F.col(key).alias("merge_key")).agg(F.min(pos).alias("first_pos"), *first, *filled, F.count(F.lit(1)).alias("n_merged"))
        if "external_ids" not in papers.columns:
            return found
        return found.join(merge_maps(rows.withColumn("merge_key", F.col(key)), "merge_key", "external_ids", pos), "merge_key", "left")

    titled = without.join(with_doi.select("title_key").distinct(), "title_key", "left_anti")
    return merged(with_doi, "doi").unionByName(merged(titled, "title_key"))


def merge_maps(rows: DataFrame, key: str, column: str, pos: str) -> DataFrame:
    """One map for each key: the entries of all its rows, the earliest row winning."""
    entries = rows.select(key, pos, F.explode(column).alias("name", "value"))
    return entries.groupBy(key, "name").agg(F.min_by("value", pos).alias("value")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias(column))


def first_of(rows: DataFrame, keys: list, pos: str) -> DataFrame:
    """The earliest row of each key."""
    order = Window.partitionBy(*keys).orderBy(pos)
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def last_of(rows: DataFrame, keys: list, pos: list) -> DataFrame:
    """Upsert: the latest row of each key."""
    order = Window.partitionBy(*keys).orderBy(*(F.desc(p) for p in pos))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def quota(rows: DataFrame, query: str, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each query."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit)


def only_new(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known; rows without a key always pass."""
    have = known.filter(~missing(F.col(key))).select(F.lower(F.trim(key)).alias("_key")).distinct()
    return found.withColumn("_key", F.when(~missing(F.col(key)), F.lower(F.trim(key)))).join(have, "_key", "left_anti").drop("_key")


def snowball(rows: DataFrame, pos: str, width: int = 60) -> DataFrame:
    """Rows, taken in the order of ``pos``, whose DOI and title start no row kept before has.

    One pair of seen sets holds for all rows, and a row that is dropped registers
    neither of its keys. With DOIs and title starts as nodes and rows as edges,
    this is the greedy matching in order: an edge that comes first at both its
    nodes is kept, and those that it meets go. All such edges are decided in one
    round; rounds follow until none is open, few of them unless the keys form a
    chain that runs in order. Each round is two aggregations and two anti joins,
    and is written, so no key's rows come together in a task.

    DOIs are compared trimmed and in lower case, an empty or null one is none; of
    titles the first ``width`` characters, trimmed and in lower case, and an empty
    or null title is a key as any other. Of rows with one position and both keys
    equal one is kept; rows of one position are taken by DOI (none first), then title.
    """
    trimmed = lambda c: F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    doi, start = trimmed(F.col("doi")), F.substring(trimmed(F.coalesce("title", F.lit(""))), 1, width)
    keyed = rows.select("*", F.when(doi != "", doi).alias("_doi"), start.alias("_start"))
    # of rows that share both keys only the first can be kept
    least = materialise(keyed.groupBy("_doi", "_start").agg(F.min(pos).alias("_pos")))
    left, rounds = least, []
    while not left.isEmpty():
        at = F.struct("_pos", "_doi", "_start")
        first = left.groupBy("_start").agg(F.min(at).alias("e")).select("e.*")
        first_doi = left.filter("_doi IS NOT NULL").groupBy("_doi").agg(F.min(at).alias("e")).select("e.*")
        both = first.filter("_doi IS NULL").unionByName(first.join(first_doi, ["_pos", "_doi", "_start"]).select("_pos", "_doi", "_start"))
        kept = materialise(both)
        rounds.append(kept)
        before = left
        left = materialise(before.join(kept.select("_start"), "_start", "left_anti").join(kept.filter("_doi IS NOT NULL").select("_doi"), "_doi", "left_anti").select("_pos", "_doi", "_start"))
        release(before)
    if not rounds:
        return rows.limit(0)
    kept = reread(rounds).withColumnsRenamed({c: f"{c}_kept" for c in ("_pos", "_doi", "_start")})
    same = (F.col(pos) == F.col("_pos_kept")) & F.col("_doi").eqNullSafe(F.col("_doi_kept")) & (F.col("_start") == F.col("_start_kept"))
    return keyed.dropDuplicates([pos, "_doi", "_start"]).join(kept, same, "left_semi").select(*rows.columns)
