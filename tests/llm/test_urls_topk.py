import numpy as np

from scholium.llm import topk, urls


def test_url_parts_and_rules(spark):
    rows = ["HTTP://A.Example.NET/en/1?x#y", "http://b.net", "http://b.net/", "x://Example.com/de/2", "http://my.org/fr/", "http://org/fr/x", "noturl", None, "http://exampleXnet/en/", "a://b://c/d?e", "http://fooexample.com/de/2", "://h?q/", "http://x.com/a\nb"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(rows)] + [(None, None, "z")], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, labels).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("b.net", "", None, "allow")
    assert got[2] == ("b.net", "/", "net/", "block")
    assert got[3] == ("example.com", "/de/2", "example.com/de/", "block")
    assert got[4][2:] == ("org/fr/", "allow") and got[5][2:] == ("org/fr/", "allow")
    assert got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None)
    assert got[9][:2] == ("b:", "//c/d") or got[9][:2] == ("b:", "//c/d")
    assert got[10][2] is None and got[11][:2] == ("h", "") and got[12][1] == "/a\nb"
    assert len(got) == len(rows) + 1
    assert urls.judge(pages.limit(0), labels).collect() == []


def test_impure_template_is_rejected(spark):
    pages = spark.createDataFrame([(i, f"http://h.com/{'spam' if i < 60 else 'news'}/{i}") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 60), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labels).collect()}
    assert all(got[i] == ("block" if i < 60 else "allow") for i in range(200))


def test_bad_sections_among_many_and_deep_ones(spark):
    good = [f"http://h.com/dir{chr(97 + i % 26)}{chr(97 + i // 26)}/a/{k}" for i in range(40) for k in range(10)]
    bad = [f"http://h.com/bad/x/{k}" for k in range(30)]
    deep = [f"http://d.com/a/b/c/d/{'spam' if k % 2 else 'fine'}/{k}" for k in range(120)]
    rows = good + bad + deep
    pages = spark.createDataFrame([(i, f"{u.rsplit('/', 1)[0]}/{i}") for i, u in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int("/bad/" not in u and "/spam/" not in u), 0) for i, u in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.template) for r in urls.judge(pages, labels).collect()}
    for i, u in enumerate(rows):
        assert got[i][0] == ("block" if "/bad/" in u or "/spam/" in u else "allow")
    assert got[0][1] == "h.com/*/a/{n}" and got[len(good)][1] == "h.com/bad/x/{n}"


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [-1.0, -2.0]), (100, [1e15, -1e15]), (200, [])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, vec string")
    vectors = topk.integers(table)
    got = topk.search(vectors.filter("vec_id % 100 = 0"), vectors, 3).collect()
    assert sorted((r.rank, r.vec_id) for r in got if r.query_id == 0) == [(1, 1), (2, 2), (3, 8)]
    assert [r.score for r in got if r.query_id == 0 and r.vec_id == 1] == [1024**2 + 2048**2]
    assert not [r for r in got if r.query_id == 200]
    assert topk.search(vectors.limit(0), vectors, 3).collect() == []


def test_pruning_is_exact():
    rnd = np.random.default_rng(3)
    block = rnd.integers(-50, 50, (500, 64)) * (rnd.random((1, 64)) < 0.3)
    queries, ids = block[:20].astype(np.float64), rnd.permutation(500)
    q, c, s = topk.best_of_block(queries, ids[:20], block.astype(np.float64), ids, 10, np.full(20, -np.inf))
    scores = block[:20] @ block.T
    for i in range(20):
        want = sorted((-scores[i, j], ids[j]) for j in range(500) if j != i)[:10]
        assert [(-int(v), ids[j]) for v, j in zip(s[q == i], c[q == i], strict=True)] == want


def test_pairs_are_pruned_and_none_is_lost(monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 300)
    rnd = np.random.default_rng(4)
    held = np.floor(rnd.standard_normal((3_000, 64)) * 1024 / 8)
    ids = rnd.permutation(3_000)
    for kind in (np.float64, np.int64, object):
        block = held.astype(np.int64).astype(kind)
        found = {}
        for q, c, s in topk.best_of_blocks(block[:7], ids[:7], block, ids, 10):
            for i, j, v in zip(q, c, s, strict=True):
                found.setdefault(int(i), []).append((-int(v), int(ids[j])))
        scores = held[:7] @ held.T
        for i in range(7):
            assert sorted(found[i])[:10] == sorted((-int(scores[i, j]), int(ids[j])) for j in range(3_000) if j != i)[:10]
        assert sum(map(len, found.values())) < 7 * 100  # later blocks send less than their ten best


def test_small_blocks_of_both_sides(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [i % 7, -(i % 5), i % 3]) for i in range(200)], "vec_id long, vec array<long>")
    rank = lambda: sorted(map(tuple, topk.search(vectors.filter("vec_id % 10 = 0"), vectors, 4).collect()))
    whole = rank()
    monkeypatch.setattr(topk, "QUERY_BYTES", 200)
    monkeypatch.setattr(topk, "CANDIDATE_BYTES", 1_000)
    assert rank() == whole and len(whole) == 80
