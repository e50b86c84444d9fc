"""Remedies against a plain loop over each review, and the evidence map against plain grouping."""

import random
from collections import Counter

from scholium.operators import evidence, remediation

SCHEMAS = {
    "queries": "review string, db string, query string",
    "candidates": "review string, paper int, score int, topic string",
    "screened": "review string, paper int, topic string, how string",
    "suggestions": "review string, topic string, db string, query string",
    "topics": "review string, topic string, query string",
    "offers": "review string, query string, paper int, score int, topic string",
    "gaps": "review string, topic string, severity string, needed int",
}


def plain(rows, caps, threshold=3):
    """One review after the other, one remedy after the other."""
    of = lambda name, r: [x[1:] for x in rows[name] if x[0] == r]
    out, audit = {n: set() for n in ("queries", "candidates", "screened")}, set()
    for r in {x[0] for n in SCHEMAS for x in rows[n]}:
        queries, candidates, screened = set(of("queries", r)), {c[0]: c for c in of("candidates", r)}, {s[0]: s for s in of("screened", r)}
        done, number, acted = Counter(), 0, True
        while acted:
            number, acted = number + 1, False
            for action in ("expand_queries", "lower_screening_threshold", "retry_gap_search"):
                if action == "expand_queries":
                    asked = {q for _, q in queries}
                    cause = {t for t, _ in of("topics", r)} - {t for t, q in of("topics", r) if q in asked}
                elif action == "retry_gap_search":
                    have = Counter(s[1] for s in screened.values())
                    cause = {t for t, severity, needed in of("gaps", r) if severity == "major" and have[t] < needed}
                else:
                    cause = {1} if candidates and 1 - len(screened) / len(candidates) > 0.8 else set()
                if not cause or done[action] >= caps.get(action, 0):
                    continue
                done[action] += 1
                acted = True
                if action == "expand_queries":
                    dbs = {d for d, _ in queries}
                    new = {(d, q) for t, d, q in of("suggestions", r) if t in cause and d in dbs} - queries
                    queries |= new
                    changed = len(new)
                elif action == "lower_screening_threshold":
                    new = [c for p, c in candidates.items() if p not in screened and c[1] >= threshold - 1]
                    screened.update({p: (p, t, "lowered") for p, _, t in new})
                    changed = len(new)
                else:
                    asked = {q for t, _, q in of("suggestions", r) if t in cause}
                    best = {}
                    for q, p, score, t in of("offers", r):
                        if q in asked and p not in candidates:
                            best[p] = min(best.get(p, (score, t)), (score, t))
                    candidates.update({p: (p, *x) for p, x in best.items()})
                    passed = {p: (p, x[1], "gap") for p, x in best.items() if x[0] >= threshold}
                    screened.update(passed)
                    changed = len(passed)
                audit.add((number, r, action, len(cause), changed))
        for n, found in (("queries", queries), ("candidates", candidates.values()), ("screened", screened.values())):
            out[n] |= {(r, *x) for x in found}
    return out, audit


def made(seed):
    rnd = random.Random(seed)
    rows = {n: [] for n in SCHEMAS}
    for r in ("r0", "r1", "r2", "r3", "r4", "r5"):
        topics = [f"t{k}" for k in range(4)]
        rows["queries"] += {(r, rnd.choice("ab"), f"q{rnd.randrange(6)}") for _ in range(3)}
        for p in range(rnd.choice([0, 5, 20])):
            score, topic = rnd.choice([1, 1, 2, 2, 2, 3]), rnd.choice(topics)
            rows["candidates"].append((r, p, score, topic))
            if score >= 3:
                rows["screened"].append((r, p, topic, "first"))
        rows["suggestions"] += {(r, rnd.choice(topics), rnd.choice("abc"), f"q{rnd.randrange(12)}") for _ in range(10)}
        rows["topics"] += {(r, t, f"q{rnd.randrange(12)}") for t in topics for _ in range(2)}
        rows["offers"] += [(r, f"q{rnd.randrange(12)}", 100 + rnd.randrange(30), rnd.choice([1, 3, 4]), rnd.choice(topics)) for _ in range(25)]
        rows["gaps"] += [(r, t, rnd.choice(["major", "minor"]), rnd.choice([0, 1, 4])) for t in topics[:3]]
    return rows


def test_remedies_equal_a_plain_loop(spark):
    for seed, caps in ((1, remediation.CAPS), (2, {"retry_gap_search": 1})):
        rows = made(seed)
        frames = {n: spark.createDataFrame(rows[n], schema) for n, schema in SCHEMAS.items()}
        state = remediation.State(*(frames[n] for n in ("queries", "candidates", "screened")))
        world = remediation.World(*(frames[n] for n in ("suggestions", "topics", "offers", "gaps")))
        found, audit = remediation.remedy(state, world, caps)
        want, entries = plain(rows, caps)
        for n in want:
            got = [tuple(r) for r in getattr(found, n).select(*(c.split()[0] for c in SCHEMAS[n].split(", "))).collect()]
            assert len(got) == len(want[n]) and set(got) == want[n], n
        assert {tuple(r) for r in audit.collect()} == entries and (seed != 1 or len({e[2] for e in entries}) == 3)


def test_nothing_to_mend(spark):
    frames = {n: spark.createDataFrame([], schema) for n, schema in SCHEMAS.items()}
    found, audit = remediation.remedy(remediation.State(*(frames[n] for n in ("queries", "candidates", "screened"))), remediation.World(*(frames[n] for n in ("suggestions", "topics", "offers", "gaps"))))
    assert audit.collect() == [] and found.screened.collect() == []


def parts(spark):
    return (
        spark.createDataFrame([("t1", "One"), ("t2", "Two"), ("t3", None)], "theme string, name string"),
        spark.createDataFrame([("t1", 2, 0, "b", "weak"), ("t1", 1, 1, "a2", "odd"), ("t1", 1, 0, "a", "strong"), ("t9", 1, 0, "lost", "weak"), (None, 1, 0, "lost", "weak"), ("t2", 5, 0, None, None)], "theme string, paper int, pos int, claim string, strength string"),
        spark.createDataFrame([("t1", 2, 1, "x"), ("t1", 1, 2, "y")], "theme string, left int, right int, text string"),
        spark.createDataFrame([("t1", p, y) for p, y in ((1, 2000), (2, 2001), (3, 2003), (4, 2004), (4, 2004), (5, None))] + [("t2", 1, 2000), ("t2", 2, 2009)], "theme string, paper int, year int"),
        spark.createDataFrame([("t1", "g", "minor", 0.5), ("t2", "h", "minor", 0.1), ("t2", "i", "major", 0.9)], "theme string, topic string, severity string, coverage double"),
    )


def test_evidence_map(spark):
    found = {r.theme: r for r in evidence.evidence_map(*parts(spark)).collect()}
    assert set(found) == {"t1", "t2", "t3"}
    one = found["t1"]
    assert [f.claim for f in one.findings] == ["a", "a2", "b"] and [c.text for c in one.contradictions] == ["y", "x"]
    assert one.strengths.asDict() == {"strong": 1, "moderate": 0, "weak": 1, "preliminary": 0, "other": 1}
    assert [(p.paper, p.year) for p in one.papers] == [(1, 2000), (2, 2001), (3, 2003), (4, 2004), (5, None)]
    assert tuple(one.progression) == (2000, 2004, 2, 2) and one.severity == "minor"
    assert found["t2"].progression is None and found["t2"].severity == "major" and [g.topic for g in found["t2"].gaps] == ["h", "i"]
    assert found["t3"].findings == [] and found["t3"].severity is None and found["t3"].name is None


def test_evidence_map_takes_one_exchange(spark):
    plan = evidence.evidence_map(*parts(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_section_bundles(spark):
    sections = spark.createDataFrame([("1", ["t2", "t1"]), ("2", ["no"]), ("3", []), ("4", None)], "section string, themes array<string>")
    got = {r.section: [b.theme for b in r.bundle] for r in evidence.section_bundles(sections, evidence.evidence_map(*parts(spark))).collect()}
    assert got == {"1": ["t2", "t1"], "2": [], "3": [], "4": []}
