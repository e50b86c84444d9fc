import hashlib
import random
from collections import Counter

from scholium.llm import queries, substring
from tests.llm.test_jaccard import equal_hashes


def brute(texts, k):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(2)
    passages = [" ".join(rnd.choices("abcdefghij", k=rnd.choice([6, 9, 14]))) for _ in range(6)]
    texts = []
    for _ in range(150):
        parts = [rnd.choice(passages) if rnd.random() < 0.3 else " ".join(rnd.choices("abcdefghijklmnop", k=4)) for _ in range(rnd.choice([1, 3, 8]))]
        texts.append("\n ".join(parts))
    texts += ["x " * 300, "x " * 90, "y\xa0z " * 50, None, "", "  ", texts[0], texts[5]] + ["same words in many documents here again and again"] * 40
    rows = [(i, t, "m") for i, t in enumerate(texts)] + [(7, texts[7], "m"), (8, "other " + texts[8], "m"), (None, texts[9], "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mini string")
    for hot in (3, 1000):
        got = substring.remove_repeats(docs, window=6, gram=3, hot=hot).collect()
        want = [(r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], 6), strict=True)]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert substring.remove_repeats(docs.limit(0), window=6).collect() == []


def test_query_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op3_substring(spark, "/root/testdata/sf0.01").collect()}
    want = brute([r.text for r in docs], 35)
    assert got == {r.doc_id: (n, g, hashlib.sha256(k.encode()).hexdigest()) for r, (n, g, k) in zip(docs, want, strict=True)}
    assert sum(g for _, g, _ in want) > 0


def test_rows_of_one_id_and_one_32_bit_hash(spark):
    a, b = equal_hashes(spark)
    rows = [(None, a), (None, b), (7, b)]
    got = sorted((r.n_removed for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [0, 40, 40]
