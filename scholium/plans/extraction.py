"""Queries on article texts, batched extraction and validated replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import schemas
from scholium.operators import extraction
from scholium.plans.registry import query
from scholium.session import shared_folder, table
from scholium.sources import articles

PARSED = r"""lines AS (SELECT doc_id, trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS l, n FROM (SELECT doc_id, unnest(p) AS l, generate_subscripts(p, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))),
bodies AS (SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (n % 3 <> 2 AND l <> ''), '') AS body FROM lines GROUP BY 1)"""


@query(rf"""WITH {PARSED}, paragraphs AS (SELECT doc_id, 'About' || doc_id || 'in short' || chr(10) || string_agg(l, chr(10) ORDER BY n) FILTER (n % 3 <> 2) AS all_text FROM lines GROUP BY 1)
SELECT doc_id, length(t) AS n_chars, md5(t) AS text FROM (SELECT doc_id, CASE WHEN length(body) > 100 THEN left(body, 200000) WHEN length(all_text) > 100 THEN left(all_text, 200000) END AS t FROM bodies JOIN paragraphs USING (doc_id))""")
def article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of article XML made of each document: its lines as paragraphs, every third one in a figure, and an abstract."""
    docs = table(spark, sf_dir, "documents")
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    figure = lambda l: F.concat(F.lit("<fig id='f'><caption><p>"), l, F.lit("</p></caption></fig>"))
    paragraphs = F.transform(F.split(escaped, "\n"), lambda l, n: F.when(n % 3 == 2, figure(l)).otherwise(F.concat(F.lit('<p n="1">'), l, F.lit("</p>"))))
    front = F.concat(F.lit('<?xml version="1.0"?><!DOCTYPE article SYSTEM "x.dtd"><article><front><p>About <i>'), F.col("doc_id").cast("string"), F.lit("</i> in short</p></front><body><sec>"))
    xml = docs.select("doc_id", F.concat(front, F.array_join(paragraphs, ""), F.lit("</sec></body></article>")).alias("xml"))
    text = xml.select("doc_id", articles.text_of(F.col("xml"), "jats").alias("text"))
    return text.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 20 AS BIGINT) AS batch, md5(left(text, 2000)) AS summary, length(text) AS n_chars FROM documents")
def batched_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers extracted in batches of twenty by a run that was stopped after two waves and went on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    work = lambda papers: papers.select("doc_id", "batch", F.md5(F.substring("text", 1, 2000)).alias("summary"), F.length("text").cast("long").alias("n_chars"))
    folder = shared_folder(spark)
    extraction.run(docs, ["doc_id"], work, folder, waves=5, stop_after=2)
    extraction.run(docs, ["doc_id"], work, folder, waves=5)
    return extraction.extracted(spark, folder)


#: What an extraction must look like.
REPLY = {
    "type": "object",
    "properties": {
        "paper": {"type": "integer", "minimum": 0},
        "kind": {"enum": ["click", "view", "purchase", "error", "signup", "login", "logout"]},
        "findings": {"type": "array", "items": {"$ref": "#/$defs/Finding"}, "minItems": 1},
        "year": {"anyOf": [{"type": "integer"}, {"type": "null"}]},
    },
    "required": ["paper", "findings"],
    "additionalProperties": False,
    "$defs": {"Finding": {"type": "object", "properties": {"claim": {"type": "string", "minLength": 2}, "score": {"type": "number", "maximum": 1}}, "required": ["claim"]}},
}


@query("""SELECT event_id, CASE event_id % 10 WHEN 0 THEN '$: no JSON' WHEN 1 THEN '$.findings: missing' WHEN 2 THEN '$.kind: not one of ["click", "view", "purchase", "error", "signup", "login", "logout"]' WHEN 3 THEN '$.findings[1].score: over 1'
        WHEN 4 THEN '$.findings[0].claim: shorter than 2' WHEN 5 THEN '$.extra: not known' WHEN 6 THEN '$.year: none of the options' END AS error,
    CASE WHEN event_id % 10 >= 7 THEN user_id END AS paper, CASE WHEN event_id % 10 >= 7 THEN 2 END AS n_findings, CASE WHEN event_id % 10 >= 7 THEN event_type END AS claim FROM events""")
def validated_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies read by their schema, and what is wrong with those that break it."""
    events = table(spark, sf_dir, "events")
    fault = F.col("event_id") % 10
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    first = F.concat(F.lit('{"claim": '), text(F.when(fault == 4, "x").otherwise(F.col("event_type"))), F.lit("}"))
    second = F.concat(F.lit('{"claim": "it holds", "score": '), F.when(fault == 3, "1.5").otherwise("0.5"), F.lit("}"))
    fields = [
        F.concat(F.lit('"paper": '), F.col("user_id").cast("string")),
        F.concat(F.lit('"kind": '), text(F.when(fault == 2, "other").otherwise(F.col("event_type")))),
        F.when(fault != 1, F.concat(F.lit('"findings": ['), first, F.lit(", "), second, F.lit("]"))),
        F.when(fault == 5, F.lit('"extra": 1')),
        F.concat(F.lit('"year": '), F.when(fault == 6, '"2001"').when(fault == 7, "null").otherwise("2001")),
    ]
    whole = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.when(fault != 0, "}").otherwise(""))
    replies = events.select("event_id", F.when(fault == 8, F.concat(F.lit("As asked:\n```json\n"), whole, F.lit("\n```"))).otherwise(whole).alias("reply"))
    found = schemas.validated(replies, "reply", REPLY)
    return found.select("event_id", "error", F.col("value.paper").alias("paper"), F.when(F.col("error").isNull(), F.size("value.findings")).alias("n_findings"), F.col("value.findings")[0]["claim"].alias("claim"))
