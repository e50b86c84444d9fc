"""The queries opN_<name> of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm import bpe, conversations, decontam, html, jaccard, licences, periodic, pii, quality, substring, token_counts, topk, urls
from scholium.session import materialise, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids and decoded text, as digests."""
    encoded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; held-out labels are not learned."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: base counts and digest, and all spans."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("base", pii.base_only(F.col("spans")))
    counts = [pii.count(F.col("base"), kind.name).alias(f"n_{kind.name}") for kind in pii.KINDS if kind.base]
    return found.select("doc_id", *counts, F.sha2(F.encode(pii.listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), pii.scores(F.col("spans")).alias("scores"))


@query
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text and its length in code points."""
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by its path template."""
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


ORACLE_SQL["op8_urls"] = urls.duckdb_sql()


@query
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector, exactly."""
    vectors = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors.filter(F.col("vec_id") % 100 == 0), vectors, 10)


ORACLE_SQL["op6_topk"] = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
QUALIFY rank <= 10
"""


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, encoded as a whole."""
    return token_counts.count_sections(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated 35-word windows."""
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL["op3_substring"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d) ANTI JOIN gone USING (rid, j) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage similar to a benchmark item, and where."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class under 4-gram Jaccard similarity of 85 % or more."""
    return jaccard.link(table(spark, sf_dir, "documents"), n=4, percent=85)


ORACLE_SQL["op7_jaccard"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) LEFT JOIN sizes USING (doc_id)
"""


@query
def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of repeated words, and its words without their repeats."""
    docs = periodic.repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.find(docs).withColumn("best", periodic.longest(F.col("runs")))
    best = [F.col("best")[c].alias(c) for c in ("start", "length", "period")]
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli")
    digest = lambda c, name: F.sha2(F.encode(c, "UTF-8"), 256).alias(name)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, exponent, digest(periodic.listed(F.col("runs")), "runs_sha256"), digest(F.col("kept"), "collapsed_sha256"), "n_words")


@query
def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence notices, tags and expressions."""
    found = licences.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["word"])
    named = lambda places: F.transform(places, lambda p: p["label"])
    every = F.concat(named(F.col("places")), F.flatten(F.transform("expressions", lambda e: e["labels"])))
    said = F.transform("expressions", lambda e: e["expression"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), licences.joined(named(base)).alias("base_labels"), licences.joined(every).alias("labels"), F.col("licence_score").alias("score"),
        F.array_join(said, "; ").alias("expressions"), F.array_max(F.transform("expressions", lambda e: e["step"])).alias("step"),
    )


@query
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and its cheapest repair."""
    examined = materialise(conversations.examine(conversations.damage(table(spark, sf_dir, "conversations"))))
    parsed = materialise(conversations.parse(examined))
    hashed = conversations.digests(examined, parsed).withColumnRenamed("conv_id", "_conv")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return parsed.join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(*parsed.columns, F.coalesce("repaired_sha256", none).alias("repaired_sha256"))


ORACLE_SQL["op13_conversations"] = conversations.duckdb_sql()
