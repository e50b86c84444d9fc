"""Search, screening and totals on small frames."""

from pyspark.sql import functions as F

from scholium.operators import screening


def test_sources_are_merged_in_their_order(spark):
    shape = "rank int, title string, doi string, year int, source_database string, citation_count int"
    one = spark.createDataFrame([(1, "First", "10.1/A", 2010, "one", None), (2, "Second", None, 2011, "one", 3), (3, "Old", "10.1/o", 1990, "one", 1)], shape)
    two = spark.createDataFrame([(1, "second!", "", 2011, "two", 7), (2, "Else", "https://doi.org/10.1/a", 2012, "two", 5), (3, "First", None, 2012, "two", 5)], shape)
    found = {r.merge_key: (r.title, r.source_database, r.year, r.citation_count, r.n_merged) for r in screening.multi_source_search([one, two, one.limit(0)], 2000, None).collect()}
    assert found == {"10.1/a": ("First", "one", 2010, 5, 2), "second": ("Second", "one", 2011, 3, 2)}


def test_seeds_first_ids_and_totals(spark):
    rows = spark.createDataFrame([("g", 1, "a", 5), ("g", 2, "", 9), ("g", 3, None, 9), ("g", 4, "b", None), ("g", 5, "c", 5), ("h", 1, "d", None)], "g string, pos int, s2_id string, citation_count int")
    assert sorted((r.g, r.seed, r.s2_id) for r in screening.top_cited(rows, ["g"], 2).collect()) == [("g", 1, "a"), ("g", 2, "c"), ("h", 1, "d")]
    ids = spark.createDataFrame([("x", 3), ("y", 1), ("x", 2), (None, 0), ("z", 9)], "k string, t int")
    assert [r.k for r in screening.first_seen(ids, "k", ["t"], 2).collect()] == ["y", "x"] and screening.first_seen(ids, "k", ["t"]).count() == 3
    usage = spark.createDataFrame([({"input_tokens": 5},), (None,), ({"output_tokens": 2, "cache_read": 7},)], "token_usage map<string,int>")
    assert tuple(screening.token_totals(usage).first()) == (5, 2) and tuple(screening.token_totals(usage.limit(0)).first()) == (0, 0)


def test_decisions_by_batch_and_index(spark):
    papers = spark.createDataFrame([(k,) for k in range(45)], "id int")
    decisions = spark.createDataFrame([(0, 0, 9, 1), (0, 0, -3, 2), (0, 20, 4, 3), (0, -1, 4, 4), (2, 4, 3, 5), (2, 5, 3, 6), (1, None, 3, 7)], "batch long, index long, score int, pos int")
    assert sorted((r.id, r.score) for r in screening.decided(papers, decisions, ["id"]).collect()) == [(0, 1), (44, 3)]
    scores = spark.createDataFrame([(s,) for s in (5, 4, 3, 2, None)], "s int")
    assert [r[0] for r in scores.select(screening.model_for(F.col("s"))).collect()] == ["large", "large", "small", "large", "large"]
    assert [r[0] for r in scores.select(screening.model_for(F.col("s"), enabled=False)).collect()] == [None] * 5
