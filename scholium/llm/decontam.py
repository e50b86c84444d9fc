"""Benchmark decontamination on DataFrame functions alone.

Documents and benchmark items are sequences of lower-cased words (runs of
letters and digits); shingles are five words. For each length that items have,
a window of that length is laid at every start where enough of its shingles
occur in some items of the length; no other window can reach the similarity with
any of them. Which item a window resembles is found by fingerprints alone:
windows and items get a 64-bit SimHash of their shingles, weighted by how often
they occur. Fingerprints are cut into ``RADIUS`` + 1 blocks, so that any two
within ``RADIUS`` bits agree in a block, and joined on (length, block, value).
Pairs within the radius are verified by the weighted Jaccard similarity of their
shingles, exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.words import row_keys
from scholium.session import materialise, release

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 fingerprints differ in 10 bits of 64, give or take 3.
RADIUS = 20
#: Bytes that may be broadcast, by the length of the rows as JSON.
BROADCAST_BYTES = 32 << 20
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def _grams(hashes: str) -> Column:
    """Hashes of the shingles of an array of word hashes."""
    own = ", ".join(f"{hashes}[i + {j}]" for j in range(SHINGLE))
    return F.expr(f"transform(sequence(0, size({hashes}) - {SHINGLE}), i -> xxhash64({own}))")


def _fingerprint(grams: str) -> Column:
    """SimHash: bit b is the sign of the sum of the shingles' bits b."""
    return F.expr(
        f"aggregate(transform(sequence(0, 63), b -> IF(aggregate({grams}, 0, (a, x) -> a + IF((shiftright(x, b) & 1L) = 1L, 1, -1)) > 0, shiftleft(1L, b), 0L)), 0L, (a, x) -> a | x)"
    )


def _starts() -> Column:
    """Starts of the windows that hold enough shared shingles.

    Of the sorted places, the i-th is the first that a window holds if the
    window starts after the one before; it holds ``need`` of them if it reaches
    the place ``need`` - 1 further on. Each start comes from one i.
    """
    low = "greatest(IF(i = 0, 0, places[i - 1] + 1), places[i + need - 1] - width + 1)"
    high = "least(places[i], last)"
    # filters may be evaluated later than this: too few places give no i
    firsts = "IF(need >= 1 AND size(places) >= need, sequence(0, greatest(size(places) - need, 0)), CAST(array() AS array<int>))"
    ranges = f"transform({firsts}, i -> struct({low} AS low, {high} AS high))"
    return F.expr(f"flatten(transform(filter({ranges}, r -> r.low <= r.high), r -> sequence(r.low, r.high)))")


def _values(fingerprint: Column, radius: int) -> list[Column]:
    """radius + 1 blocks that cover the 64 bits."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]


def _blocks(fingerprint: str, radius: int) -> Column:
    """(block, value) of each block."""
    return F.array(*(F.struct(F.lit(i).alias("block"), v.alias("value")) for i, v in enumerate(_values(F.col(fingerprint), radius))))


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table, marked for broadcast where its rows are measured and small, else as it is."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold a passage similar to a benchmark item.

    Returns key, item_id, start (word of the document, from 0), n_words (of the
    item) and similarity: the best window of each document and item, the first
    of equals. Null and short texts hold nothing, and items of under five words
    match nothing. Repeated rows count once. Other columns are not read.
    """
    items = (
        benchmark.select("item_id", words(F.col("text")).alias("item_words"))
        .filter(F.size("item_words") >= SHINGLE)
        .distinct()
        .withColumn("hashes", F.expr("transform(item_words, w -> xxhash64(w))"))
        .withColumn("grams", _grams("hashes"))
        .select(F.monotonically_increasing_id().alias("item"), "item_id", "item_words", F.size("item_words").alias("length"), "grams", _fingerprint("grams").alias("item_print"))
    )
    items = materialise(items)
    shared = materialise(items.select("length", F.explode("grams").alias("gram")).distinct())

    rows = docs.select(*row_keys(key, text), F.col(text).alias("text")).filter(F.length("text") >= 2 * SHINGLE - 1)
    hashed = rows.select("key", "row", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes")).filter(F.size("hashes") >= SHINGLE)
    met = hashed.select("key", "row", F.size("hashes").alias("n"), F.posexplode(_grams("hashes")).alias("place", "gram")).join(small(shared), "gram")
    places = met.groupBy("key", "row", "n", "length").agg(F.array_sort(F.collect_set("place")).alias("places"))
    # so many shingles must be shared within one window; the fraction is for the rounding of doubles
    places = places.withColumn("width", F.least("n", "length") - SHINGLE + 1).withColumn("last", F.greatest(F.col("n") - F.col("length"), F.lit(0)))
    places = places.withColumn("need", F.ceil(similarity * (F.col("width") + F.col("length") - SHINGLE + 1) / (1 + similarity) - 1e-6).cast("int")).filter(F.size("places") >= F.col("need"))
    places = places.withColumn("starts", _starts())
    windows = materialise(places.select("key", "row", "length", F.explode("starts").alias("start")).groupBy("key", "row").agg(F.collect_list(F.struct("start", "length")).alias("windows")))

    held = small(windows)
    cut = (
        rows.join(held, [rows["key"].eqNullSafe(held["key"]), rows["row"] == held["row"]])
        .select(rows["key"], rows["row"], "text", "windows")
        .dropDuplicates(["key", "row"])
        .withColumn("words", words(F.col("text")))
        .select("key", "row", F.explode(F.transform("windows", lambda w: F.struct(w["start"].alias("start"), w["length"].alias("length"), F.slice("words", w["start"] + 1, w["length"]).alias("words")))).alias("w"))
        .select("key", "row", "w.*")
    )
    prints = materialise(cut.withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))")).withColumn("grams", _grams("hashes")).withColumn("print", _fingerprint("grams")).drop("hashes", "grams"))

    # blocks travel without the words
    indexed = materialise(items.select("item", "length", "item_print", F.explode(_blocks("item_print", radius)).alias("b")).select("item", "length", "item_print", "b.*"))
    pairs = prints.select("key", "row", "start", "length", "print", F.explode(_blocks("print", radius)).alias("b")).select("*", "b.*").drop("b").join(small(indexed), ["length", "block", "value"])
    # a pair that agrees in several blocks counts in the first of them
    differs = F.col("print").bitwiseXOR(F.col("item_print"))
    first = F.coalesce(*(F.when(v == 0, i) for i, v in enumerate(_values(differs, radius))))
    met = pairs.filter((F.bit_count(differs) <= radius) & (F.col("block") == first)).select(F.col("key").alias("met_key"), F.col("row").alias("met_row"), F.col("start").alias("met_start"), F.col("length").alias("met_length"), "item")
    met = materialise(met)
    same = [F.col("key").eqNullSafe(F.col("met_key")), F.col("row") == F.col("met_row"), F.col("start") == F.col("met_start"), F.col("length") == F.col("met_length")]
    near = prints.join(met, same).select("key", "row", "start", "length", "words", "item").join(small(items.select("item", "item_id", "item_words")), "item")
    near = materialise(near)  # else the similarity is computed in several places
    string_grams = lambda c: f"transform(sequence(1, size({c}) - {SHINGLE - 1}), i -> array_join(slice({c}, i, {SHINGLE}), ' '))"
    times = lambda c: f"size(filter({c}, y -> y = x))"
    least = f"aggregate(array_distinct(g.a), 0, (s, x) -> s + least({times('g.a')}, {times('g.b')}))"
    # arguments of a lambda are computed once, columns in each place that names them
    bound = f"transform(transform(array(struct({string_grams('words')} AS a, {string_grams('item_words')} AS b)), g -> struct({least} AS least, size(g.a) + size(g.b) AS total)), t -> t.least / (t.total - t.least))[0]"
    scored = near.withColumn("similarity", F.expr(bound)).filter(F.col("similarity") >= similarity)
    best = scored.groupBy("key", "row", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "length")).alias("best"))
    found = best.select(F.col("key").alias(key), "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.length").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity")).distinct()
    found = materialise(found)
    release(items, shared, windows, prints, indexed, met, near)
    return found
