"""Generated references against reference lists, review by review.

The entries of a review meet in one row. A short review is compared within that
row, every pair whose entries are not both matched yet; the pairs of a long one
are candidates that share rare elements, joined over all tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from scholium.functions.references import matched_doi, second_part
from scholium.functions.text import match_tokens
from scholium.operators.joins import indel, indel_ratio
from scholium.session import materialise

JACCARD, RATIO = 0.45, 80.0
#: Reviews of more entries, of both sides together, are compared by candidates; a routing parameter, the matches are the same.
SHORT = 256


def sharing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (review, left, right) that may have enough elements in common.

    Both sides are (review, id, elements, least): different elements, and how
    many of them any partner must have. Such a pair shares one of the
    size - least + 1 rarest elements, so only those are joined.
    """
    each = lambda df: df.select("review", "id", "least", F.size("elements").alias("size"), F.explode("elements").alias("e"))
    seen = each(a).select("e").unionAll(each(b).select("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    rare = Window.partitionBy("review", "id").orderBy("n", "e")
    prefix = lambda df, name: each(df).join(seen, "e").withColumn("place", F.row_number().over(rare)).filter(F.col("place") <= F.col("size") - F.col("least") + 1).select("review", "e", F.col("id").alias(name))
    return prefix(a, "left").join(prefix(b, "right"), ["review", "e"]).select("review", "left", "right").distinct()


def pieces(norm: Column) -> Column:
    """Pairs of neighbouring characters, repeats numbered; short texts have an empty piece as well."""
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(norm) - 1, F.lit(1))), lambda i: F.substring(norm, i, F.lit(2))), lambda p: F.length(p) == 2)
    numbered = F.transform(F.array(pairs), lambda ps: F.transform(ps, lambda p, i: F.concat(p, F.lit("#"), F.size(F.filter(F.slice(ps, F.lit(1), i), lambda q: q == p)).cast("string"))))[0]
    return F.when(F.length(norm) <= 3, F.array_append(numbered, F.lit(""))).otherwise(numbered)


def keyed(refs: DataFrame) -> DataFrame:
    """refs (review, id, ref) with doi, tokens of the title, norm and usable."""
    tokens = match_tokens(second_part(F.col("ref")))
    found = refs.select("review", "id", "ref", matched_doi(F.col("ref")).alias("doi"), tokens.alias("tokens")).withColumn("norm", F.array_join("tokens", " "))
    return found.withColumn("usable", (F.col("norm") != "") | F.col("doi").isNotNull())


def matched_pairs(a: DataFrame, b: DataFrame, jaccard: float = JACCARD, ratio: float = RATIO) -> DataFrame:
    """Pairs of a review that match: equal DOI, else title words, else the ratio of the sorted words.

    The ratio is taken only where a side has no partner yet. A ratio of 80 of
    100 leaves titles of lengths m and n with 0.2 (m + n) - 1 or more
    neighbouring characters in common, and n at least two thirds of m, so m / 3
    - 1 of its pieces; this bounds the candidates and loses none.
    """
    by_doi = a.filter("doi IS NOT NULL").select("review", F.col("id").alias("left"), "doi").join(b.filter("doi IS NOT NULL").select("review", F.col("id").alias("right"), "doi"), ["review", "doi"]).select("review", "left", "right")
    words = lambda df: df.select("review", "id", F.array_distinct("tokens").alias("elements")).filter(F.size("elements") > 0).withColumn("least", F.ceil(jaccard * F.size("elements") - 1e-9))
    x, y = words(a), words(b)
    both = sharing(x, y).join(x.select("review", F.col("id").alias("left"), F.col("elements").alias("x")), ["review", "left"]).join(y.select("review", F.col("id").alias("right"), F.col("elements").alias("y")), ["review", "right"])
    by_words = both.filter(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")) >= jaccard).select("review", "left", "right")
    done = by_doi.unionByName(by_words).distinct()
    open_a = a.join(done.select("review", F.col("left").alias("id")).distinct(), ["review", "id"], "left_anti")
    open_b = b.join(done.select("review", F.col("right").alias("id")).distinct(), ["review", "id"], "left_anti")
    least = F.greatest(F.lit(1), F.ceil(F.length("norm") * (ratio / 100 * 2.5 - 5 / 3) - 1 - 1e-9))
    spelled = lambda df: df.select("review", "id", pieces(F.col("norm")).alias("elements"), least.alias("least"))
    near = sharing(spelled(open_a), spelled(b)).unionByName(sharing(spelled(a), spelled(open_b))).distinct()
    texts = near.join(a.select("review", F.col("id").alias("left"), F.col("norm").alias("x")), ["review", "left"]).join(b.select("review", F.col("id").alias("right"), F.col("norm").alias("y")), ["review", "right"])
    m, n = F.length("x"), F.length("y")
    close = texts.filter(200 * F.least(m, n) >= ratio * (m + n)).filter(indel("x", "y") >= ratio).select("review", "left", "right")
    return done.unionByName(close).distinct()


def matches(dois: list[str | None], norms: list[str | None], other_dois: list[str | None], other_norms: list[str | None], jaccard: float = JACCARD, ratio: float = RATIO) -> tuple[list[bool], list[bool]]:
    """Which entries of either side have a match on the other: equal DOI, else title words, else the ratio of the sorted words."""
    both_dois = {d for d in dois if d is not None} & {d for d in other_dois if d is not None}
    both_norms = {n for n in norms if n is not None} & {n for n in other_norms if n is not None}
    left = [d in both_dois or n in both_norms for d, n in zip(dois, norms, strict=True)]
    right = [d in both_dois or n in both_norms for d, n in zip(other_dois, other_norms, strict=True)]
    if all(left) and all(right):
        return left, right
    words, other_words = ([set(n.split(" ")) if n else set() for n in side] for side in (norms, other_norms))
    for i, x in enumerate(norms):
        for j, y in enumerate(other_norms):
            if (left[i] and right[j]) or x is None or y is None:
                continue
            common = len(words[i] & other_words[j])
            alike = common and common / (len(words[i]) + len(other_words[j]) - common) >= jaccard
            if alike or (200 * min(len(x), len(y)) >= ratio * (len(x) + len(y)) and indel_ratio(x, y) >= ratio):
                left[i] = right[j] = True
    return left, right


#: Rows whose strings are Python objects at once.
CHUNK = 256


@F.arrow_udf(StructType([StructField(side, ArrayType(BooleanType())) for side in ("made", "wanted")]))
def matched_in_row(made_dois: pa.Array, made_norms: pa.Array, wanted_dois: pa.Array, wanted_norms: pa.Array) -> pa.Array:
    found: list[dict] = []
    for start in range(0, len(made_dois), CHUNK):
        columns = [c.slice(start, CHUNK).to_pylist() for c in (made_dois, made_norms, wanted_dois, wanted_norms)]
        found += [dict(zip(("made", "wanted"), matches(*row), strict=True)) for row in zip(*columns, strict=True)]
    return pa.array(found, pa.struct([("made", pa.list_(pa.bool_())), ("wanted", pa.list_(pa.bool_()))]))


def listed(entries: DataFrame, *fields: str) -> DataFrame:
    """A row for each review with the entries of its sides, in the order of their ids. Without an id of the review, the sides are apart."""
    side = lambda made: F.array_sort(F.collect_list(F.when(F.col("made") == made, F.struct("id", *fields))))
    return entries.groupBy("review", F.when(F.col("review").isNull(), F.col("made")).alias("_alone")).agg(side(True).alias("made"), side(False).alias("wanted")).drop("_alone")


def compared(entries: DataFrame) -> DataFrame:
    """entries (review, made, id, ref, doi, norm, usable): a row for each review with the lists made and wanted of (id, ref, usable, hit)."""
    crowded = materialise(entries.groupBy("review").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHORT).select("review"))
    several = not crowded.isEmpty()
    rows = listed(entries.join(crowded, "review", "left_anti") if several else entries, "ref", "doi", "norm", "usable")
    hits = matched_in_row("made.doi", "made.norm", "wanted.doi", "wanted.norm")
    marked = lambda side: F.transform(side, lambda e, k: F.struct(e["id"].alias("id"), e["ref"].alias("ref"), e["usable"].alias("usable"), F.get(F.col(f"hits.{side}"), k).alias("hit"))).alias(side)
    found = rows.withColumn("hits", hits).select("review", marked("made"), marked("wanted"))
    if not several:
        return found
    many = entries.join(crowded, "review", "left_semi")
    pairs = matched_pairs(many.filter("made").drop("made"), many.filter("NOT made").drop("made"))
    seen = pairs.select("review", F.explode(F.array(F.struct(F.lit(True).alias("made"), F.col("left").alias("id")), F.struct(F.lit(False).alias("made"), F.col("right").alias("id")))).alias("e")).select("review", "e.made", "e.id", F.lit(True).alias("found")).distinct()
    return found.unionByName(listed(many.join(seen, ["review", "made", "id"], "left").withColumn("hit", F.col("found").isNotNull()), "ref", "usable", "hit"))





def match_citations(generated: DataFrame, reference: DataFrame) -> DataFrame:
    """Each review's matched, missed and invented references, with precision, recall and F1.

    Both sides are (review, id, ref), ids unique in a review. Many may match
    one. A reference without title words and DOI takes no part but counts in
    the lengths of the lists. A review that is on one side only has zeros.
    matched, missed (of the reference list) and hallucinated (of the generated
    one) are lists of entries, in the order of their ids.
    """
    made, wanted = keyed(generated), keyed(reference)
    found = compared(made.withColumn("made", F.lit(True)).unionByName(wanted.withColumn("made", F.lit(False))))
    of = lambda side, keep: F.transform(F.filter(side, lambda e: e["usable"] & keep(e["hit"])), lambda e: e["ref"])
    hit, lost = lambda h: h, lambda h: ~h
    counted = found.select(
        "review", F.size("made").alias("generated_count"), F.size(of("made", hit)).alias("kept"), F.array_join(of("made", lost), "\n").alias("hallucinated"),
        F.size("wanted").alias("reference_count"), of("wanted", hit).alias("matched"), F.array_join(of("wanted", lost), "\n").alias("missed"),
    ).withColumn("matched_count", F.size("matched"))
    share = lambda k, n: F.when(F.col(n) > 0, F.col(k) / F.col(n)).otherwise(0.0)
    scored = counted.withColumns({"precision": share("kept", "generated_count"), "recall": share("matched_count", "reference_count")})
    total = F.col("precision") + F.col("recall")
    f1 = F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0)
    return scored.select("review", *(F.col(c).cast("long").alias(c) for c in ("generated_count", "reference_count", "matched_count")), F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round(f1, 4).alias("f1"), "matched", "missed", "hallucinated")
