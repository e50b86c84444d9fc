import hashlib
import random
import re

from scholium.llm import pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(number))) % 10 == 0


def brute(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(number) <= 19 and luhn(number), "phone": 8 <= len(number) <= 15}[kind]
            if ok:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


def check(rows):
    for r in rows:
        want = brute(r.text)
        own = [s for s in r.spans if s.kind in BASE]
        assert [f"{s.kind}:{s.start}:{s.end}" for s in own] == want, r.text


def test_base_spans_of_random_texts(spark):
    rnd = random.Random(5)
    parts = ["a@b.c", "_x@y.com", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "007.001.000.0255", "+", "@", ".", "-", " ", "é", "🙂", "12", "0", "x", "\n", "(", ")", "%"]
    texts = ["".join(rnd.choices(parts, k=rnd.choice([3, 10, 40]))) for _ in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check(pii.find(docs).collect())


def test_edge_rows(spark):
    made = lambda n: ["1" * n, "a" * n, "1-" * n, "a." * n + "@", "+1" + " " * n, "1." * (n // 5), "a@" + "b." * n]
    # the brute-force patterns take quadratic time on long runs
    long = made(2_000)
    huge = spark.createDataFrame([(t,) for t in made(100_000)], "text string")
    assert len(pii.find(huge).collect()) == 7
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a@b.cd"), (2, "")] + [(9, t) for t in long], "spans long, text string")
    rows = pii.find(docs).withColumnRenamed("spans", "found").collect()
    assert len(rows) == 11
    assert [r.found for r in rows[:2]] == [[], []]
    check(pii.find(docs).collect())
    assert pii.find(docs.limit(0)).collect() == []


def test_added_kinds_and_redaction(spark):
    docs = spark.createDataFrame([("iban GB82 WEST 1234 5698 7654 32 end",), ("DE89370400440532013001",), ("social security 123-45-6789",), ("part 123-45-6789",), ("mail a@b.cd or +1 555 123 4567!",), (None,)], "text string")
    found = [[s.kind for s in r.spans] for r in pii.find(docs).collect()]
    assert found == [["iban"], [], ["ssn"], [], ["email", "phone"], []]
    clean = [r.text for r in pii.redact(docs).collect()]
    assert clean == ["iban <IBAN> end", "DE89370400440532013001", "social security <SSN>", "part 123-45-6789", "mail <EMAIL> or <PHONE>!", None]


def test_redaction_keeps_other_columns(spark):
    docs = spark.createDataFrame([("a@b.cd", "own", 1)], "text string, spans string, _text int")
    assert [tuple(r) for r in pii.redact(docs).collect()] == [("<EMAIL>", "own", 1)]


def test_query_on_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op4_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]
    assert sum(r.n_email + r.n_card + r.n_phone + r.n_ip for r in rows) > 0


def test_many_spans_and_secrets(spark):
    n = 3_000
    text = " ".join(f"user{i}@mail.example.org;" for i in range(n))
    row = pii.find(spark.createDataFrame([(text,)], "text string")).first()
    assert [f"{s.kind}:{s.start}:{s.end}" for s in row.spans] == brute(text)
    assert pii.redact(spark.createDataFrame([(text + " é tail",)], "text string")).first().text == " ".join(["<EMAIL>;"] * n) + " é tail"
    docs = spark.createDataFrame([("token = 04dbebab91ab85687d33eeaaf9ac699e1188f962",), ("commit 04dbebab91ab85687d33eeaaf9ac699e1188f962",), ("call (555) 123-4567",), ("call +1 (555) 123-4567",), ("key averyveryverylongword_without",)], "text string")
    assert [[s.kind for s in r.spans] for r in pii.find(docs).collect()] == [["secret"], [], ["tel"], ["phone"], []]
