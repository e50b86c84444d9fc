"""What shows only on larger tables, on small ones made for it."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from scholium.functions.numbers import rounded
from scholium.operators import evaluation, joins, matching, resolution, themes
from scholium.plans import catalog
from tests.test_evaluation import inputs


def test_rubric_anchors_round_as_sql(spark, tmp_path):
    halves = [k / 100 for k in range(0, 60_000, 50)] + [-0.5, -100.5, 1e300, -1e308, float("inf"), float("nan"), None]
    events = spark.createDataFrame(list(enumerate(halves)), "event_id long, value double")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = catalog.QUERIES["rubric_range_join"](spark, str(tmp_path)).select("event_id", "anchor", "next_anchor").collect()
    want = con.sql(catalog.ORACLE_SQL["rubric_range_join"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    numbers = [repr(r[0]) for r in events.orderBy("event_id").select(rounded(F.col("value") / 100, 2)).collect()]
    assert numbers == [repr(r[0]) for r in con.sql("SELECT round(value / 100, 2) FROM events ORDER BY event_id").fetchall()]
    assert numbers[201] == "1.0"  # of 1.005


def reviews_of(spark, sizes):
    rng = random.Random(3)
    words = "gut axis brain river growth ab acb cell deep model flow drought".split()

    def ref(i):
        title = " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
        changed = "".join(rng.choice("abe") if rng.random() < 0.1 else c for c in title)
        return f"[{i}] Doe J. {changed}. J." + (f" 10.1234/{rng.randint(1, 40)}." if rng.random() < 0.2 else "")

    lists = {r: ([ref(i) for i in range(n)], [ref(i) for i in range(m)]) for r, (n, m) in enumerate(sizes)}
    return [spark.createDataFrame([(r, i, x) for r, v in lists.items() for i, x in enumerate(v[k])] + [(None, k, "[1] A. Deep model. J.")], "review int, id int, ref string") for k in (0, 1)]


def test_short_and_long_reviews_match_alike(spark, monkeypatch):
    sides = reviews_of(spark, [(9, 7), (0, 3), (2, 0), (30, 25), (1, 1), (12, 12)])
    found = []
    for short in (256, 20, 0):
        monkeypatch.setattr(matching, "SHORT", short)
        found.append(sorted(map(repr, matching.match_citations(*sides).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 8


def test_references_of_short_reviews_stay_in_their_row(spark):
    sides = reviews_of(spark, [(3, 3)] * 40)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(matching, "matched_pairs", None)  # no candidates are joined
        plan = matching.match_citations(*sides)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_short_reviews_are_evaluated_without_candidates(spark, monkeypatch):
    monkeypatch.setattr(matching, "matched_pairs", None)
    given = inputs(spark)
    found = {r.review: r.citations for r in evaluation.evaluate(*given).collect()}
    assert {k: (c.matched_count, c.reference_count, c.recall) for k, c in found.items() if c} == {"a": (2, 4, 0.5), "b": (0, 12, 0.0), "c d": (0, 0, 0.0)}


def test_texts_are_not_shuffled_for_themes(spark, monkeypatch):
    monkeypatch.setattr(themes, "PLACES", 16)
    monkeypatch.setattr(themes, "MOST_THEMES", 2)  # several scans
    texts = [(1, "x" * 300 + " über the hills"), (2, "ab" * 40), (2, "ab" * 40), (3, None), (4, "hills"), (5, "über th")]
    asked = ["hills", "über", "ü", "xxxxxxxx über", "abababababa", "baa", "the hills", "r th", "no such theme"]
    rows, given = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(t,) for t in asked], "theme string")
    found = joins.containing(rows, given, "id", "t", "theme")
    assert sorted(map(tuple, found.collect())) == sorted((k, t) for k, x in texts for t in asked if x and t in x)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [20_000_000, 500])
def test_pairs_of_queries_are_not_brought_together_again(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(joins, "TASK_PAIRS", most)
    spark.createDataFrame([(s,) for s in [*range(120), 3, 3, -7, None]], "l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p % 900, p % 7) for p in range(1000)] + [(1, None), (None, 3)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = catalog.QUERIES["query_section_papers"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, con.sql(catalog.ORACLE_SQL["query_section_papers"]).fetchall()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Aggregate" in x and "p_partkey" in x and ("section" in x or "l_suppkey" in x)]


def test_titles_that_cannot_be_alike_are_not_compared(monkeypatch):
    rng = random.Random(2)
    base = ["".join(rng.choices("abcdefgh é", k=rng.choice([5, 70, 300]))) for _ in range(8)]
    changed = lambda t: "".join(rng.choice("xab") if rng.random() < rng.choice([0, 0.1, 0.4]) else c for c in t)
    asked, known = ([changed(t) for t in base for _ in range(3)] for _ in range(2))
    asked, known = list(dict.fromkeys(asked + ["zzzz" * 20])), list(dict.fromkeys(known))
    want = []
    for i, x in enumerate(asked):
        score, back = max((joins.indel_ratio(x, y), -j) for j, y in enumerate(known))
        want += [(i, -back, score)] if score >= 70 else []
    for sizes in ((64, 1 << 14, 1 << 11, 1 << 22), (3, 5, 1 << 11, 1), (8, 50, 60, 1 << 22), (64, 1 << 14, 0, 1 << 22)):
        for name, size in zip(("KINDS", "PAIRS", "LONG", "MASKS"), sizes, strict=True):
            monkeypatch.setattr(resolution, name, size)
        assert resolution.best_in_block(asked, known, 70.0) == want
    # the lengths fit, the letters do not
    left, right = resolution.Block(["zzzz" * 20, base[1]], ["qrst" * 20, base[1] + "h"], 70.0).candidates()
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(1, 1)]
