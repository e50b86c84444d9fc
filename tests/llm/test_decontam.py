import random
import re
from collections import Counter

import pytest

from scholium.llm import decontam, queries


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs, items, similarity=0.8):
    """Best weighted Jaccard over every item-sized window."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            own = words(item)
            n, b = len(own), grams(own)
            if n < 5 or not b.keys() & grams(w).keys():
                continue
            for s in range(max(1, len(w) - n + 1)):
                a = grams(w[s : s + n])
                both = sum((a & b).values())
                if both and both / (a.total() + b.total() - both) >= similarity:
                    out[d, i] = max(out.get((d, i), 0), both / (a.total() + b.total() - both))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([3, 5, 12, 30, 45])))) for i in range(12)] + [(12, "the same the same the same the same the same"), (13, None)]
    docs = []
    for d in range(80):
        base = rnd.choices(vocabulary, k=rnd.choice([0, 4, 40, 200]))
        own = words(rnd.choice(items)[1])
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            if own:
                j = rnd.randrange(len(own))
                own[j : j + rnd.choice([0, 1])] = rnd.choices(vocabulary, k=rnd.choice([0, 1]))
        at = rnd.randrange(len(base) + 1)
        docs.append((d, "; ".join(base[:at] + own + base[at:]).title()))
    docs += [(80, None), (81, ""), (None, items[3][1]), (5, docs[5][1])]
    got = decontam.contaminated(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == pytest.approx(want)
    assert len(got) == len(want) > 10
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontam.contaminated(empty, spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_moved_blocks(spark):
    rnd = random.Random(7)
    items, docs = [], []
    for i, n in enumerate((40, 59, 59, 80, 120, 200)):
        own = [f"i{i}w{k}" for k in range(n)] if i != 2 else (["a", "b", "c", "d", "e", "f", "g"] * 9)[:n]
        items.append((i, " ".join(own)))
        for cut in (n // 2, n // 3, n - 6):
            around = [f"z{rnd.randrange(500)}" for _ in range(150)]
            docs.append((len(docs), " ".join(around[:60] + own[cut:] + own[:cut] + around[60:])))
        docs.append((len(docs), " ".join(own[n // 2 :] + own[: n // 2])))
    docs += [(len(docs), " ".join(items[1][1].split()[:-4])), (len(docs) + 1, items[2][1] + " " + items[2][1])]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == pytest.approx(want)
    assert len(got) == len(want) > 15


def test_query_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, "/root/testdata/sf0.01").collect()}
    assert {(d, i) for d, t in docs for i, x in items if x in t} <= got
    assert got == brute(docs, items).keys()
