import hashlib
import random
import zlib

from scholium.llm import periodic, queries


def brute_runs(w, least=12):
    """Maximal stretches of each period by comparing words p apart; the least period of a stretch stays."""
    n, found = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i < n - p and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, 2 * p):
                found.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def damaged(key, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(w)
    if key is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def expected(key, text):
    w = damaged(key, text)
    runs = brute_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_cover_has_every_difference():
    assert {(a - b) % periodic.COVER for a in periodic.RESIDUES for b in periodic.RESIDUES} == set(range(periodic.COVER))


def test_runs_of_random_words():
    rnd = random.Random(3)
    for _ in range(150):
        docs = []
        for _ in range(rnd.choice([1, 3, 12])):
            n, kinds = rnd.choice([0, 1, 5, 20, 60, 200, 500]), rnd.choice([1, 2, 3, 5, 30])
            w = [rnd.randrange(kinds) for _ in range(n)]
            if rnd.random() < 0.6 and n > 10:
                a = rnd.randrange(n)
                p = 1 + rnd.randrange(max(1, (n - a) // 2))
                w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            docs.append(w)
        assert [[tuple(map(int, r)) for r in rows] for rows in periodic.runs_of(docs)] == [brute_runs(w) for w in docs]


def test_fibonacci_words_and_many_pairs(monkeypatch):
    a, b = [0], [0, 1]
    while len(b) < 1_500:
        a, b = b, b + a
    want = brute_runs(b)
    assert len(want) > 100
    assert [tuple(map(int, r)) for r in periodic.runs_of([b])[0]] == want
    # pairs grown in many parts give the same
    monkeypatch.setattr(periodic, "PAIRS", 50)
    assert [tuple(map(int, r)) for r in periodic.runs_of([b, [7] * 40])[0]] == want


def test_edge_rows(spark):
    long = "a b c " * 40_000
    rows = [(1, None, "x"), (2, "", "x"), (None, "a " * 12, "y"), (2, "", "x"), (3, "a " * 11, "z"), (4, "  b  " * 8, None), (5, long, ""), (6, "é\x0b\x1cé " * 9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = periodic.find(docs).orderBy("doc_id", "n_words").collect()
    assert found[0].doc_id is None and [tuple(r) for r in found[0].runs] == [(0, 12, 1)] and found[0].kept == "a"
    assert [r.n_words for r in found] == [12, 0, 0, 0, 11, 16, 120_000, 18]
    assert [tuple(r) for r in found[6].runs] == [(0, 120_000, 3)] and found[6].kept == "a b c"
    assert found[4].runs == [] and found[4].kept == " ".join("a" * 11)
    assert periodic.find(docs.limit(0)).collect() == []
    assert periodic.find(docs.select(docs.doc_id.alias("kept"), "text")).columns == ["text", "n_words", "runs", "kept"]


def test_query_on_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op11_periodic(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected(r.doc_id, texts[r.doc_id]), r.doc_id
    assert sum(r.n_runs > 0 for r in rows) > 10
