import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from scholium.llm import conversations, queries

FAULTS = ("", "blank", "duplicate", "truncated")


def exhaustive(rows):
    """Least (cost, audit) over all edits with up to two insertions at each place."""
    best = None
    choices = [[e for e in "KRD" if e == "D" or f not in ("blank", "duplicate")] for _, f in rows]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:], strict=True))
            cost = 3 * sum(gaps) + sum(4 if e == "D" else 3 * (e == "R") + 3 * (f == "truncated") for e, (_, f) in zip(edits, rows, strict=True))
            if best and (cost, audit) >= best:
                continue
            kept, k = [], 0
            for e in audit:
                if e in "IR":
                    kept.append("ua")
                elif e == "K":
                    kept.append(rows[k][0])
                k += e != "I"
            if any(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in itertools.product(*kept)):
                best = (cost, audit)
    return best


def forward(rows):
    """The same by one pass from the left over the states of the form, for long conversations."""
    step = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}

    def closed(cells):
        for _ in range(4):
            for q, (x, a) in list(cells.items()):
                for c in "ua":
                    if r := step.get((q, c)):
                        cells[r] = min(cells.get(r, (x + 3, a + "I")), (x + 3, a + "I"))
        return cells

    cells = closed({"0": (0, "")})
    for c, f in rows:
        more = {}
        for q, (x, a) in cells.items():
            options = [(q, x + 4, a + "D")]
            if f not in ("blank", "duplicate"):
                t = 3 * (f == "truncated")
                options += [(step[q, c], x + t, a + "K")] if (q, c) in step else []
                options += [(step[q, d], x + 3 + t, a + "R") for d in "ua" if (q, d) in step]
            for r, cost, audit in options:
                more[r] = min(more.get(r, (cost, audit)), (cost, audit))
        cells = closed(more)
    return min(cells[q] for q in "0A" if q in cells)


def expected(rows):
    """Contract results of all conversations, row by row."""
    said = lambda x: " " if x is None else str(x)
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        group, role, text = groups[conv], said(role), said(text)
        h = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        group.extend([(turn, "user" if h == 4 else role, text)] * (1 + (h == 3)))
    found = {}
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in group:
            inner = text.strip(" \t\n\r\x0b\x0c")
            faults.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in group if t is not None]
        initials = [r[:1] for _, r, _ in group]
        cost, audit = forward(list(zip(initials, faults, strict=True)))
        out, k, user = [], 0, False
        for e in audit:
            if e == "K":
                out.append((group[k][1], group[k][2]))
                user = group[k][1][0] == "u"
            elif e in "IR":
                user = not user
                out.append(("user" if user else "assistant", group[k][2] if e == "R" else ""))
            k += e != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        found[conv] = (gaps, *(faults.count(f) for f in FAULTS[1:]), illegal, cost, audit, sha)
    return found


def test_cells_against_all_edits():
    rnd = random.Random(2)
    for n in (0, 1, 2, 3, 4):
        for _ in range(6 if n < 4 else 8):
            rows = [(rnd.choice("suaux"), rnd.choice(FAULTS + ("", ""))) for _ in range(n)]
            want = exhaustive(rows)
            assert forward(rows) == want
            assert conversations.cheapest(conversations.together([dict(conversations._row(*r)) for r in rows])) == want


def test_cells_in_any_blocks():
    rnd = random.Random(4)
    for _ in range(200):
        rows = [(rnd.choice("suaaux"), rnd.choice(FAULTS + ("",) * 6)) for _ in range(rnd.choice([5, 9, 30, 120]))]
        cut = rnd.randrange(len(rows))
        halves = [conversations.together([dict(conversations._row(*r)) for r in part]) for part in (rows[:cut], rows[cut:])]
        assert conversations.cheapest(conversations.together(halves)) == forward(rows)


def compare(found, rows):
    want = expected(rows)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}
    assert len(found) == len(got) and got == want


def random_rows(seed, conversations_of):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "what", " ", "", None, "A. b ?\n", "end. ", "x\x0b", "é.", "."]
    rows = []
    for conv, n in conversations_of:
        rows += [(conv, rnd.choice([None, t, t, t, t - 1, 2 * t]), rnd.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "umpire"]), rnd.choice(texts + [f"{t}."] * 9)) for t in range(n)]
    return rows


def test_rows_of_all_kinds(spark, tmp_path):
    rows = random_rows(7, [(c, c % 9 + 1) for c in range(120)] + [(None, 7), (500, 90), (501, 1)])
    rows += rows[:40]
    folder = f"{tmp_path}/in"
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS gone", "'x' AS audit")
    frame.write.parquet(f"{folder}/conversations.parquet")
    compare(queries.op13_conversations(spark, folder).collect(), rows)


def test_blocks_meet_in_rounds(spark):
    rows = random_rows(9, [(1, 300), (2, 40), (3, 3), (None, 33)])
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examined = conversations.examine(conversations.damage(frame))
    small = conversations.parse(examined, block=4, fan=3).collect()
    whole = conversations.parse(examined).collect()
    assert sorted(small, key=repr) == sorted(whole, key=repr)
    assert {r.conv_id: (r.cost, r.audit) for r in whole} == {c: x[5:7] for c, x in expected(rows).items()}


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Go on"), (2, 0, "system", "Be kind."), (3, 5, "user", "One."), (3, 6, "user", "Two.")]
    examined = conversations.examine(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    parsed = conversations.parse(examined)
    turns = [tuple(r) for r in conversations.repaired(examined, parsed).orderBy("conv_id", "place").collect()]
    assert turns == [(1, 0, "user", "", "I"), (1, 1, "assistant", "Hello.", "K"), (3, 0, "user", "One.", "K"), (3, 1, "assistant", "Two.", "R")]
    assert [(r.cost, r.audit) for r in parsed.orderBy("conv_id").collect()] == [(7, "IKD"), (4, "D"), (3, "KR")]
    assert conversations.parse(examined.limit(0)).collect() == [] and conversations.digests(examined.limit(0), parsed.limit(0)).collect() == []


def test_query_on_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(queries.op13_conversations(spark, folder).collect(), rows)
