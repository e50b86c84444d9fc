"""From documents to token ids: the corpus pipeline as five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. All but the last return the columns of documents; rows without an id are
never dropped by a stage that names documents by id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm import bpe, decontam, jaccard, pii, quality
from scholium.session import materialise, release, table


def _fresh(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with underscores where the documents have them."""
    return tuple(next(f for k in range(len(docs.columns) + 1) if (f := n + "_" * k) not in docs.columns) for n in names)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    names = _fresh(docs, "score", "predicted")
    return quality.score(docs, model, carry=tuple(docs.columns), names=names).filter(F.col(names[1]) == 1).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies (five words, 80 %)."""
    linked = jaccard.link(docs, n=5, percent=80)
    copies = materialise(linked.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    release(linked)
    kept = docs.join(decontam.small(copies), "doc_id", "left_anti").select(*docs.columns)
    if docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    # rows repeated as they are have one id and one text
    return kept.filter(F.col("doc_id").isNull()).unionByName(kept.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage similar to a benchmark item."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    ids = materialise(found.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct())
    return docs.join(decontam.small(ids), "doc_id", "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and the decoded text."""
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact_personal_data),
    ("BPE encoding and decoding", encode_tokens),
]

#: The classifier and the tokenizer cannot be expressed in SQL; tests/llm compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        if place:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
