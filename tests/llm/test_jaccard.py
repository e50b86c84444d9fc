import random

import pytest
from pyspark.sql import functions as F

from scholium.llm import jaccard, queries


def grams(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [grams(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted([(k, len(sets[i]), k if not sets[i] else least.get(root(i))) for i, (k, _) in enumerate(rows)], key=repr)


def edited(words, times, rnd, vocabulary):
    words = list(words)
    for _ in range(times):
        words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
    return words


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_against_brute_force(spark, n, percent):
    rnd = random.Random(n)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for size in (3, 5, 8, 12, 20, 40, 80, 150, 300):
        for _ in range(3):
            base = rnd.choices(vocabulary, k=size)
            for k in range(rnd.choice([1, 4, 12])):
                texts.append(" ".join(edited(base, rnd.choice([0, 1, 2, size // 40, size // 25, size // 15]) if k else 0, rnd, vocabulary)))
                if rnd.random() < 0.2:
                    texts.append("  " + texts[-1].upper())
    chain = rnd.choices(vocabulary, k=120)  # neighbours link, ends do not
    for _ in range(15):
        texts.append(" ".join(chain))
        chain = edited(chain, 2, rnd, vocabulary)
    texts += [None, "", " \n", "x " * 500, "X\tx " * 20, "one", "ONE"]
    rnd.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, texts[9]), (None, "alone in here")]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, node string")
    got = sorted(map(tuple, jaccard.link(docs, n, percent).collect()), key=repr)
    assert got == brute(rows, n, percent)
    assert jaccard.link(docs.limit(0), n, percent).collect() == []


def test_large_group_of_near_copies(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = rnd.choices(vocabulary, k=200)
    rows = [(i, " ".join(edited(base, rnd.choice([1, 2, 3, 4, 6]), rnd, vocabulary))) for i in range(250)]
    got = sorted(map(tuple, jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()), key=repr)
    assert got == brute(rows, 4, 85)


def test_nodes_that_clash(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([2, 6, 30])))) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " more" * (i % 2)) for i in range(0, 150, 7)]
    got = sorted(map(tuple, jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, node_bits=9).collect()), key=repr)
    assert got == brute(rows, 4, 85)


def test_rows_of_one_id_and_one_32_bit_hash(spark):
    a, b = equal_hashes(spark)
    rows = [(None, a), (None, b), (5, a + " z"), (6, b + " z")]
    got = sorted(map(tuple, jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()), key=repr)
    assert got == brute(rows, 4, 85)
    assert {c for _, _, c in got} == {5, 6}


def equal_hashes(spark):
    """Two texts of 40 different words that Spark's 32-bit hash does not tell apart."""
    texts = spark.range(300_000).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), (F.col("id") * 41 + i).cast("string"))), " ").alias("text"))
    met = texts.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("texts")).filter(F.size("texts") > 1)
    return met.first().texts[:2]


def test_query_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op7_jaccard(spark, "/root/testdata/sf0.01").select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == brute(rows, 4, 85)
    assert sum(c != d for d, _, c in got) > 50
