"""Evaluation of reviews in one pass, and the sink for their reports."""

import json

import pytest
from pyspark.sql import functions as F

from scholium.operators import evaluation, matching, metrics
from scholium.sources import reports


def inputs(spark):
    ref = lambda t: f"Smith J. {t}. Journal. 2020."
    titles = ["Deep learning of protein folds", "Graph networks for molecules", "Statistics of rare events", "Cells under slow stress"]
    reviews = spark.createDataFrame([("a", "# One\nSome words [1] here.\n# Two\nMore words.", "bio", "big"), ("b", None, "bio", None), ("c d", "text", "chem", "small")], "review string, text string, domain string, tier string")
    generated = spark.createDataFrame([("a", k, ref(t)) for k, t in enumerate([titles[0], titles[1], "Something made up entirely"])] + [("c d", 0, ref(titles[0]))], "review string, id int, ref string")
    reference = spark.createDataFrame([("a", k, ref(t)) for k, t in enumerate(titles)] + [("b", k, ref(f"Paper number{k} of words{k}")) for k in range(12)], "review string, id int, ref string")
    topics = spark.createDataFrame([("a", "x", True, True), ("a", "y", False, True), ("a", "z", True, False), ("c d", "x", True, None)], "review string, topic string, in_generated boolean, in_reference boolean")
    scores = spark.createDataFrame([("a", "synthesis", 4.0, 3.0, {"depth_of_view": 4.0, "breadth": 3.5}), ("a", "writing", 3.0, 4.5, {})], "review string, part string, generated double, reference double, dimensions map<string,double>")
    return reviews, generated, reference, topics, scores


def test_rows_equal_the_parts_taken_apart(spark):
    given = inputs(spark)
    found = {r.review: r for r in evaluation.evaluate(*given).collect()}
    assert set(found) == {"a", "b", "c d"}
    apart = {r.review: r.asDict() for r in matching.match_citations(given[1], given[2]).collect()}
    for review in found:
        assert found[review].citations.asDict() == {k: v for k, v in apart[review].items() if k != "review"}
    shape = {r.review: r.s for r in given[0].select("review", metrics.structure(F.col("text")).alias("s")).collect()}
    assert {k: r.structure for k, r in found.items()} == shape
    a = found["a"]
    assert a.citations.recall == 0.5 and (a.topics.coverage, a.topics.both, a.topics.only_reference, a.topics.only_generated) == (0.5, ["x"], ["y"], ["z"])
    assert a.overall == round(0.25 * 0.5 + 0.30 * 0.8 + 0.25 * 0.5 + 0.20 * 0.6, 4)
    assert found["b"].overall == 0.0 and found["c d"].topics.coverage == 0.0


def test_summary_by_group(spark):
    rows = evaluation.summary(evaluation.evaluate(*inputs(spark)), "domain", "tier").collect()
    overall = {(r.domain, r.tier): (r.mean, r.n) for r in rows if r.measure == "overall"}
    assert overall[None, None][1] == 3 and overall["bio", None][1] == 2 and overall[None, "big"][1] == 1
    assert {r.measure for r in rows} == {"overall", "recall", "coverage"}


def test_report_text(spark):
    found = {r.review: r.t for r in evaluation.evaluate(*inputs(spark)).select("review", evaluation.report(F.lit("2026-01-01")).alias("t")).collect()}
    a = found["a"]
    for line in ("| Citation Recall | 0.50 | — | — |", "| Synthesis Depth | 4.0/5 | 3.0/5 | +1.00 |", "| Topical Coverage | 0.50 | 1.00 | -0.50 |", "- **Recall:** 50.0% (2/4 reference papers matched)", "| Depth Of View | 4.0 | — |", "- **Only in reference:** y", "| Dimension | Generated | Reference |\n|---|---|---|"):
        assert line in a, line
    assert "- ... and 2 more" in found["b"] and found["b"].count("- Smith J.") == 10 and "- **In both:** none" in found["b"]


def test_reports_are_in_place_only_when_all_are_written(spark, tmp_path):
    folder = f"{tmp_path}/out"
    rows = spark.createDataFrame([(f"r{k} é+%.md", f"body {k}") for k in range(20)] + [("empty.md", None)], "name string, body string").repartition(4)
    reports.save(rows, folder)
    assert sorted(map(tuple, reports.read(spark, folder).collect())) == sorted([(f"r{k} é+%.md", f"body {k}") for k in range(20)] + [("empty.md", "")])
    assert len(reports.listed(folder)) == 21 and not list((tmp_path / "out").glob("_staging*"))
    failing = rows.withColumn("name", F.concat(F.lit("n"), "name")).withColumn("body", F.when(F.col("name").startswith("nr7"), F.raise_error(F.lit("stopped"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="stopped"):
        reports.save(failing, folder)
    with pytest.raises(Exception, match="of one name"):
        reports.save(spark.createDataFrame([("new.md", "x"), ("new.md", "y")], "name string, body string"), folder)
    assert len(reports.listed(folder)) == 21 and {p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")} == {*reports.listed(folder), "_reports.json"}
    reports.save(spark.createDataFrame([("only.json", json.dumps({"a": 1}))], "name string, body string"), folder, overwrite=True)
    assert [r.name for r in reports.read(spark, folder).collect()] == ["only.json"]
    with pytest.raises(Exception, match="not a name"):
        reports.save(spark.createDataFrame([("../x", "")], "name string, body string"), folder)


def test_a_task_that_outlives_its_write_leaves_nothing(tmp_path):
    writer = reports.ReportWriter(f"{tmp_path}/out", False)

    def rows():
        yield {"name": "a.md", "body": "x"}
        writer.abort([])
        yield {"name": "b.md", "body": "y"}

    with pytest.raises(OSError):
        writer.write(rows())
    with pytest.raises(OSError):  # one that begins after the end
        writer.write(iter([{"name": "c.md", "body": "z"}]))
    assert not list((tmp_path / "out").glob("_staging*"))
