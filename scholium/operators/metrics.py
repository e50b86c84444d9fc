"""Counts, summary statistics, coverage checks, evaluation and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions.text import LETTERS, bound, citation_count, markdown_sections, missing, strip_markdown, syllables, word_count

# fixed values: evidence levels, strongest first; US dollars for a million tokens (input, output)
LEVELS = ("strong", "moderate", "weak", "preliminary")
WEIGHTS = {"recall": 0.25, "synthesis": 0.30, "coverage": 0.25, "writing": 0.20}


def counts_with_expected(rows: DataFrame, key: str, expected: list[str]) -> DataFrame:
    """Rows for each expected key, with 0 for those that have none."""
    wanted = rows.sparkSession.createDataFrame([(e,) for e in expected], f"{key} string")
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("n").isNull().alias("is_missing"))


def coverage_anomaly(rows: DataFrame) -> DataFrame:
    """One row: candidates (source, abstract, screened, included) checked for rejection and missing abstracts.

    Rejection over 80 % warns once 10 rows are screened, missing abstracts over
    50 % warn; each warning takes a quarter of the score.
    """
    total, screened = F.count(F.lit(1)), F.count_if("screened")
    rejection = F.round(F.coalesce(F.try_divide(F.count_if(F.col("screened") & ~F.col("included")), screened), F.lit(0.0)), 3)
    no_abstract = F.round(F.coalesce(F.try_divide(F.count_if(missing(F.col("abstract"))), total), F.lit(0.0)), 3)
    seen = rows.agg(total.alias("candidates"), screened.alias("n_screened"), rejection.alias("rejection_rate"), no_abstract.alias("no_abstract_rate"), F.count_distinct("source").alias("sources"))
    warned = ((F.col("rejection_rate") > 0.8) & (F.col("n_screened") >= 10)).cast("int") + (F.col("no_abstract_rate") > 0.5).cast("int")
    return seen.withColumn("score", F.greatest(F.lit(0.0), 1 - 0.25 * warned)).withColumn("status", F.when(warned > 0, "warning").otherwise("passed"))


def strength_distribution(findings: DataFrame, key: str, strength: str) -> DataFrame:
    """Findings of each level and the dominant level; of equals the stronger, '' without any."""
    n = [F.count_if(F.col(strength) == level).alias(level) for level in LEVELS]
    counted = findings.groupBy(key).agg(*n)
    best = F.array_max(F.array(*(F.struct(F.col(level).alias("n"), F.lit(-i).alias("place"), F.lit(level).alias("level")) for i, level in enumerate(LEVELS))))
    return counted.withColumn("dominant", F.when(best["n"] > 0, best["level"]).otherwise(""))


def stats(value: str, places: int = 4) -> list[Column]:
    """mean, std, low, high and n of a column, rounded; zeros where there is nothing."""
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), places)
    return [zero(F.avg(value)).alias("mean"), zero(F.stddev_samp(value)).alias("std"), zero(F.min(value)).alias("low"), zero(F.max(value)).alias("high"), F.count(value).alias("n")]


def grouped_stats(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Statistics overall and by each key alone; rows without the key are in no group of it."""
    sets = [[], *([F.col(k)] for k in keys)]
    found = rows.groupingSets(sets, *keys).agg(*(F.grouping(k).alias(f"_{k}") for k in keys), *stats(value))
    whole = [F.col(f"_{k}") == 1 for k in keys]
    named = [F.col(k).isNotNull() for k in keys]
    kept = whole[0]
    for w in whole[1:]:
        kept = kept & w
    for n in named:
        kept = kept | n
    return found.filter(kept).drop(*(f"_{k}" for k in keys))


def precision_recall(matched: Column, generated: Column, reference: Column) -> list[Column]:
    """precision, recall and f1 from counts; 0 where a denominator is."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = share(matched, generated), share(matched, reference)
    return [F.round(x, 4).alias(n) for n, x in (("precision", p), ("recall", r), ("f1", share(2 * p * r, p + r)))]


def weighted_overall() -> Column:
    """Overall score of recall, synthesis, coverage and writing (the last three of 0 to 5)."""
    parts = [w * (F.col(k) if k == "recall" else F.col(k) / 5) for k, w in WEIGHTS.items()]
    return F.round(parts[0] + parts[1] + parts[2] + parts[3], 4)


def token_cost(usage: DataFrame, prices: list[tuple[str, float, float]]) -> DataFrame:
    """usage (model, tokens_in, tokens_out) with its cost; unknown models cost nothing."""
    table = usage.sparkSession.createDataFrame(prices, "model string, price_in double, price_out double")
    # the price list is a literal of a few rows
    priced = usage.join(F.broadcast(table), "model", "left")
    part = lambda t, p: F.col(t) * F.coalesce(F.col(p), F.lit(0.0)) / 1e6
    return priced.withColumn("cost", F.round(part("tokens_in", "price_in") + part("tokens_out", "price_out"), 4)).drop("price_in", "price_out")


def reading_grade(plain: Column) -> Column:
    """Flesch-Kincaid grade: 0.39 words per sentence + 11.8 syllables per word - 15.59, two decimals; 0 without words.

    Words are runs of Latin letters. Sentences end with [.!?]; those of two words or
    less do not count, but there is one at least. Syllables are counted by rule
    (see ``syllables``); published grades divide words by a hyphenation dictionary
    and differ by a few tenths of a grade.
    """
    sentences = F.filter(F.regexp_extract_all(plain, F.lit(r"[^.!?]+"), 0), lambda x: F.regexp_count(x, F.lit(LETTERS)) > 2)
    parts = F.struct(F.regexp_count(plain, F.lit(LETTERS)).alias("words"), F.greatest(F.size(sentences), F.lit(1)).alias("sentences"), syllables(plain).alias("syllables"))
    return bound(parts, lambda p: F.when(p["words"] > 0, F.round(0.39 * p["words"] / p["sentences"] + 11.8 * p["syllables"] / p["words"] - 15.59, 2)).otherwise(0.0))


def structure(text: Column) -> Column:
    """words, sections, citations, per_1000, avg_section, cv_section and grade of a markdown text; zeros for a blank one.

    All is computed within the row, each part once. The spread is 0 for one section.
    """
    total = lambda n: F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
    squares = lambda n, mean: F.aggregate(n, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))

    def made(t: Column, n: Column, mean: Column) -> Column:
        spread = F.when((F.size(n) > 1) & (mean > 0), F.sqrt(squares(n, mean) / (F.size(n) - 1)) / mean).otherwise(F.lit(0.0))
        found = bound(strip_markdown(t), lambda plain: F.struct(word_count(plain).alias("words"), citation_count(t).alias("citations"), reading_grade(plain).alias("grade")))
        full = lambda f: F.struct(
            f["words"].alias("words"), F.size(n).alias("sections"), f["citations"].alias("citations"), F.round(F.coalesce(F.try_divide(1000.0 * f["citations"], f["words"]), F.lit(0.0)), 4).alias("per_1000"),
            F.round(mean, 2).alias("avg_section"), F.round(spread, 4).alias("cv_section"), f["grade"].alias("grade"),
        )
        return bound(found, full)

    lengths = lambda t: F.transform(markdown_sections(t), lambda p: word_count(strip_markdown(p)))
    whole = lambda t: bound(lengths(t), lambda n: bound(total(n) / F.size(n), lambda mean: made(t, n, mean)))
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("sections"), F.lit(0).alias("citations"), *(F.lit(0.0).alias(c) for c in ("per_1000", "avg_section", "cv_section", "grade")))
    return bound(text, lambda t: F.when(F.coalesce(t, F.lit("")).rlike(r"\S"), whole(t)).otherwise(none))
