"""The snowball and the prefix sums over all rows, against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from scholium.operators import dedup, ordered, rounds


def fold(rows):
    dois, titles, kept = set(), set(), []
    for pos, doi, title in sorted(rows, key=lambda r: (r[0], (r[1] or "").lower().strip(), (r[2] or "").lower().strip()[:60])):
        doi, start = (doi or "").lower().strip(), (title or "").lower().strip()[:60]
        if (doi and doi in dois) or start in titles:
            continue
        titles.add(start)
        if doi:
            dois.add(doi)
        kept.append(pos)
    return kept


def check(spark, rows):
    frame = spark.createDataFrame(rows, "pos long, doi string, title string").withColumn("_n", F.lit(1)).repartition(3)
    found = dedup.snowball(frame, "pos")
    assert found.columns == frame.columns
    assert sorted(r.pos for r in found.collect()) == fold(rows)


def test_snowball_keeps_one_seen_set_for_all_seeds(spark):
    check(spark, [(1, "10.1/x", "A"), (2, " 10.1/X", "B"), (3, "10.1/x ", "First title"), (4, None, "first title "), (5, "10.2/y", "C"), (6, "10.2/Y", "D"), (7, "", ""), (8, None, None), (9, "10.3/z", " ")])


def test_snowball_of_random_rows(spark):
    rnd = random.Random(1)
    check(spark, [(p, rnd.choice([None, "", *(f"10.{k}/D" for k in range(40))]), "t" * 60 + str(p) if p % 9 == 0 else f"Title {rnd.randrange(60)}") for p in range(300)])


def test_snowball_of_a_chain_and_a_hub(spark):
    # each row shares a key with the next: kept and dropped in turn
    check(spark, [(k, f"d{(k + 1) // 2}", f"t{k // 2}") for k in range(50)])
    # one title with very many DOIs, and one DOI with many titles
    check(spark, [(k, f"d{k}", "editorial") for k in range(300)] + [(300 + k, "d7", f"t{k}") for k in range(300)])


def test_snowball_of_nothing_and_of_copies(spark):
    check(spark, [(1, "d", "a"), (1, "d", "a"), (1, "D ", "A"), (1, "e", "b"), (2, "e", "c")])
    empty = spark.createDataFrame([], "pos long, doi string, title string")
    assert dedup.snowball(empty, "pos").collect() == []


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_prefix_sums_over_all_rows(spark, parts):
    rnd = random.Random(parts)
    rows = [(k, rnd.choice([None, rnd.randrange(50)]), rnd.choice([None, 0, rnd.randrange(100)])) for k in range(400)]
    frame = spark.createDataFrame(rows, "id long, ts int, k long").repartition(5)
    found = {r.id: r for r in ordered.placed(frame, ["ts", "id"], ("k",), parts).collect()}
    total = 0
    for place, (key, _, k) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))):
        total += k or 0
        assert (found[key].place, found[key].running_k) == (place, total)
    for budget in (1, total // 2, total - 1, total):
        stop = ordered.first_over(frame, ["ts", "id"], "k", budget, parts).collect()
        want = min((r.place for r in found.values() if r.running_k > budget), default=None)
        assert [r.place for r in stop] == ([] if want is None else [want])
    batches = {r.id: r.batch for r in ordered.all_batches(frame, ["ts", "id"], 20, parts).collect()}
    assert batches == {key: r.place // 20 for key, r in found.items()}


def test_prefix_sums_of_one_value_and_of_nothing(spark):
    same = spark.createDataFrame([(7, 1)] * 100, "ts int, k long")
    assert sorted(r.place for r in ordered.placed(same, ["ts"], ("k",), 8).collect()) == list(range(100))
    assert ordered.first_over(same, ["ts"], "k", 41).first().running == 42
    assert ordered.first_over(same, ["ts"], "k", None).collect() == [] and ordered.first_over(same, ["ts"], "k", 0).columns == ["ts", "k", "place", "running"]
    assert ordered.placed(same.limit(0), ["ts"], ("k",)).collect() == []


def test_no_range_holds_all_rows(spark):
    frame = spark.range(10_000).select("id", F.lit(1).alias("k"))
    sizes = [r["count"] for r in ordered.parts_in_order(frame, ["id"], 10).groupBy("_part").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2_500


def test_citation_frontier_and_passage_search(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(240)] + [(None, 3), (4, None)]
    passages = [(p, rnd.randrange(60)) for p in "abc" for _ in range(4)] + [("d", 999)]
    papers = [(k, rnd.choice([None, "", f"10.1/{k % 23}"]), f"Title {k % 41}") for k in range(60)]
    links = {(a, b) for a, b in edges if a is not None and b is not None}
    weight = {b: sum(y == b for _, y in links) for _, b in links}
    want = []
    for p in "abcd":
        seen = front = {x for q, x in passages if q == p}
        for hop in (1, 2, 3):
            fresh = {b for a, b in links if a in front} - seen
            best = sorted(fresh, key=lambda b: (-weight[b], b))[:5]
            want += [(p, hop, r + 1, b) for r, b in enumerate(best)]
            seen, front = seen | set(best), set(best)
    frames = [spark.createDataFrame(passages, "passage string, paper int"), spark.createDataFrame(edges, "paper int, cited int")]
    assert sorted(map(tuple, rounds.citation_frontier(*frames, hops=3, first=5).collect())) == want
    known = {"10.1/4", "10.1/9"}
    fresh = [(*w, *papers[w[3]][1:]) for w in want if papers[w[3]][1] not in known]
    kept = fold([(k, doi, title) for k, (*_, doi, title) in enumerate(fresh)])
    found = rounds.passage_search(*frames, spark.createDataFrame(papers, "paper int, doi string, title string"), spark.createDataFrame([(k,) for k in known], "doi string"), hops=3, first=5)
    assert sorted(map(tuple, found.collect())) == [(*fresh[k][:4], k) for k in kept]
