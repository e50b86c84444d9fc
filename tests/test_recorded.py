"""Recorded responses as a data source."""

import json

from pyspark.sql import functions as F

from scholium.sources import recorded


def laid(spark, folder, rows, buckets=4):
    frame = spark.createDataFrame(rows, "query string, id string, json string, at int")
    recorded.save(frame, folder, ["at"], buckets)
    return folder


def test_bounded_fetch(spark, tmp_path):
    rows = [(q, f"{q}-{k}", json.dumps({"title": f"T{k} é\n"}), k) for q in ("a", "b/c d", "é=1") for k in range(60)] + [(None, None, None, 0)]
    folder = laid(spark, f"{tmp_path}/r", rows)
    found = recorded.search(spark, folder)
    assert found.count() == 181 and found.rdd.getNumPartitions() == 4
    assert {tuple(r) for r in found.filter("query IS NULL").collect()} == {(None, 1, None, "{}")}
    # 100 / 4 queries, and never under 20
    assert recorded.search(spark, folder, max_results=100).groupBy("query").count().filter("query IS NOT NULL").select("count").distinct().collect() == [(25,)]
    assert {r["count"] for r in recorded.search(spark, folder, max_results=8).groupBy("query").count().collect()} == {1, 20}
    two = recorded.search(spark, folder, max_results=100, queries=["a", "b/c d"])
    assert sorted((r.query, r["count"]) for r in two.groupBy("query").count().collect()) == [("a", 50), ("b/c d", 50)]
    ranks = [r["rank"] for r in two.filter(F.col("query") == "b/c d").collect()]
    assert ranks == list(range(1, 51))
    assert json.loads(two.filter("id = 'a-3'").first().json) == {"title": "T3 é\n"}


def test_point_lookup_reads_one_partition(spark, tmp_path):
    rows = [(f"q{k % 7}", str(k), f'{{"k": {k}}}', k) for k in range(300)] + [("q1", "5", '{"again": 1}', 999)]
    folder = laid(spark, f"{tmp_path}/r", rows)
    found = recorded.details(spark, folder, "5")
    assert found.rdd.getNumPartitions() == 1
    assert sorted((r.query, r["rank"]) for r in found.collect()) == [("q1", 44), ("q5", 1)]
    assert recorded.details(spark, folder, "none such").collect() == []
    # the bound holds for a lookup as well, and a second filter stays with Spark
    bounded = recorded.search(spark, folder, max_results=7)
    assert [r.query for r in bounded.filter("id = '5'").collect()] == ["q5"]
    assert recorded.search(spark, folder).filter("id = '5' AND query = 'q1' AND rank > 1").count() == 1
    assert recorded.search(spark, folder).filter("query IN ('q2', 'q3')").rdd.getNumPartitions() == 2
    assert recorded.search(spark, folder, queries=["no query"]).collect() == []


def test_long_query_goes_to_several_files(spark, tmp_path):
    rows = [("hot", str(k), "{}", k) for k in range(2_000)] + [("cold", "x", "{}", 0)]
    folder = laid(spark, f"{tmp_path}/r", rows)
    assert len(list((tmp_path / "r/by_query/of=hot").glob("part-*"))) > 1
    assert [r["rank"] for r in recorded.search(spark, folder, max_results=600).filter("query = 'hot'").collect()] == list(range(1, 301))


def test_no_records(spark, tmp_path):
    folder = laid(spark, f"{tmp_path}/r", [("q", "1", "{}", 0)])
    assert recorded.search(spark, folder).filter("query = 'other'").collect() == []
