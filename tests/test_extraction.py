"""Article XML, batches that stop and go on, and validated replies."""

import pytest
from pyspark.sql import functions as F

from scholium.operators import extraction
from scholium.sources import articles

LONG = "x" * 60


def texts(spark, rows, kind):
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x string")
    return [r.t for r in frame.select("k", articles.text_of(F.col("x"), kind).alias("t")).orderBy("k").collect()]


def test_body_without_figures_and_tables(spark):
    whole = f"""<?xml version='1.0'?><!DOCTYPE a [ <!ENTITY q 'z'> ]><article><front><p>abstract</p></front><body><sec><title> T </title><p>Alpha <i>beta</i> {LONG}</p>
        <fig><caption><p>no {LONG}</p></caption></fig><table-wrap>no<fig>nor</fig></table-wrap><p>{LONG}<!-- c -->tail &nbsp;&amp; &#233;</p></sec></body></article>"""
    cdata = f"<article><body><p a='>'><![CDATA[ 1 < 2 & {LONG} ]]> and {LONG}</p></body></article>"
    two = f"<r><body>{LONG} {LONG}</body><body>second</body></r> trailing"
    assert texts(spark, [whole, cdata, two], "jats") == [f"T\nAlpha\nbeta\n{LONG}\n{LONG}\ntail & é", f"1 < 2 & {LONG}  and {LONG}", f"{LONG} {LONG}"]


def test_paragraphs_when_the_body_is_short(spark):
    short = f"<article><front><p>Alpha <i>beta</i> gamma{LONG}</p></front><body><p>short</p><fig><p>{LONG * 3}</p></fig></body><back><p>out<list><p> in {LONG}</p></list></p><p/><fig><p>kept</p></fig></back></article>"
    assert texts(spark, [short, None, "", "plain", "<a/>", "<p></p>"], "jats") == [f"Alphabetagamma{LONG}\nshort\noutin {LONG}\nin {LONG}\n\nkept", None, None, None, None, None]


def test_first_kind_of_body_that_is_there(spark):
    rows = [
        f"<x:r xmlns:x='u'><ce:sections><ce:para>short</ce:para></ce:sections><body>{LONG * 3}</body></x:r>",
        f"<r><ce:sections><ce:para>a {LONG}</ce:para><ce:para>b {LONG}</ce:para></ce:sections></r>",
        f"<r><rawtext>{LONG} {LONG}</rawtext></r>",
        f"<r><body>no</body><ce:para>a <b>{LONG}</b></ce:para><ce:para>{LONG}</ce:para></r>",
    ]
    assert texts(spark, rows, "elsevier") == [None, f"a {LONG}\nb {LONG}", f"{LONG} {LONG}", f"a{LONG}\n{LONG}"]


def test_broken_xml_is_cut_at_its_tags(spark):
    rows = [f"<a><b>open <body>q &amp; {LONG} <fig>f</fig><i>{LONG}</a>", f"<p>{LONG}<p>{LONG}", "<a><b>"]
    assert texts(spark, rows, "jats") == [f"q & {LONG}\n{LONG}", f"{LONG}\n{LONG}", None]


def test_long_texts_are_cut(spark):
    assert len(texts(spark, [f"<body>{'y' * 300_000}</body>"], "jats")[0]) == 200_000


def work(papers):
    return papers.select("id", "batch", (F.col("id") * 2).alias("twice"))


def test_a_stopped_run_goes_on(spark, tmp_path):
    papers = spark.createDataFrame([(k,) for k in range(95, -1, -1)], "id long")
    calm = f"{tmp_path}/calm"
    assert extraction.run(papers, ["id"], work, calm, size=10, waves=10) == 10
    want = sorted(map(tuple, extraction.extracted(spark, calm).collect()))
    assert want == [(k, k // 10, 2 * k) for k in range(96)]

    def fails(part):
        return work(part).withColumn("twice", F.when(F.col("batch") == 3, F.raise_error(F.lit("stopped"))).otherwise(F.col("twice")))

    folder = f"{tmp_path}/stopped"
    assert extraction.extracted(spark, folder) is None
    with pytest.raises(Exception, match="stopped"):
        extraction.run(papers, ["id"], fails, folder, size=10, waves=10)
    assert sorted(r.batch for r in extraction.ledger(spark, folder).collect()) == [0, 1, 2]
    # rows that were written but not entered are not read
    work(papers.limit(5).withColumn("batch", F.lit(3))).write.parquet(f"{folder}/rows/orphan")
    more = papers.union(spark.createDataFrame([(1000,)], "id long"))
    assert extraction.run(more, ["id"], work, folder, size=10, waves=10) == 7
    assert sorted(map(tuple, extraction.extracted(spark, folder).collect())) == want
    assert extraction.run(papers, ["id"], work, folder, size=10) == 0
    assert {(r.batch, r.n_papers) for r in extraction.ledger(spark, folder).collect()} == {(k, 10 if k < 9 else 6) for k in range(10)}
    assert extraction.run(papers.limit(0), ["id"], work, f"{tmp_path}/none") == 0
