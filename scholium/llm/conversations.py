"""Conversation repair: the cheapest edits that give a conversation its form.

The form is a system turn, if any, and then pairs of a user and an assistant
turn: ``(s?(ua)+)?`` by the initials of the roles. Its automaton has four
states, and the grammar in Chomsky normal form has one symbol [p r] for each
pair of them: what leads from p to r. The rules are [p r] -> [p q] [q r], and
[p r] -> an edit of one row, closed under insertions. A cell holds the least
(cost, audit) of a symbol over a span of rows; audits are compared as text.

Symbols compose at any row, so spans are combined bottom-up by length: rows to
pairs, pairs to fours, and so on; each length needs only the cuts in the middle.
That the least cells compose to the least whole holds as the cost of a span
follows from its audit, and of two audits of one span and one cost none is the
start of the other: it would lack an insertion, which costs.

Spark orders the rows, numbers them, and cuts long conversations into blocks
whose cells meet in rounds, so no task holds the rows of a conversation; edits
are laid and digests taken from sorted rows as they pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scholium.llm.words import lean
from scholium.session import materialise, release

#: Rows of a block, and blocks that meet in one step of a round.
BLOCK, FAN = 256, 16
BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

# fixed values: costs of the edits, and of keeping or renaming a truncated row besides
DELETE, RENAME, INSERT, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
ENDS = (START, ASSISTANT)
Cells = dict[tuple[int, int], tuple[int, str]]


def combined(left: Cells, right: Cells) -> Cells:
    """Cells of two spans put together: the least of each symbol over the states in between."""
    found: Cells = {}
    for (p, q), (x, before) in left.items():
        for r in range(4):
            other = right.get((q, r))
            if other is None:
                continue
            cost, have = x + other[0], found.get((p, r))
            if have is None or cost < have[0] or (cost == have[0] and before + other[1] < have[1]):
                found[p, r] = (cost, before + other[1])
    return found


def _least(options: list[tuple[int, int, int, str]]) -> Cells:
    found: Cells = {}
    for p, r, cost, audit in options:
        found[p, r] = min(found.get((p, r), (cost, audit)), (cost, audit))
    return found


NOTHING: Cells = {(p, p): (0, "") for p in range(4)}


@cache
def insertions() -> tuple[tuple[tuple[int, int], tuple[int, str]], ...]:
    """Closure of the insertions: nothing, or turns that lead from one state to another."""
    one = _least([(p, p, 0, "") for p in range(4)] + [(p, r, INSERT, "I") for role in "ua" for p, r in STEPS[role]])
    found = NOTHING
    while (more := combined(found, one)) != found:
        found = more
    return tuple(found.items())


@cache
def _row(initial: str, fault: str) -> tuple[tuple[tuple[int, int], tuple[int, str]], ...]:
    """Cells of one row: its edits, after any insertions."""
    options = [(p, p, DELETE, "D") for p in range(4)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED * (fault == "truncated")
        options += [(p, r, more, "K") for p, r in STEPS.get(initial, ())]
        options += [(p, r, RENAME + more, "R") for role in "ua" for p, r in STEPS[role]]
    return tuple(combined(dict(insertions()), _least(options)).items())


def together(spans: list[Cells]) -> Cells:
    """Cells of spans that follow each other, combined by pairs."""
    while len(spans) > 1:
        spans = [combined(*spans[k : k + 2]) if k + 1 < len(spans) else spans[k] for k in range(0, len(spans), 2)]
    return spans[0] if spans else NOTHING


def cheapest(cells: Cells) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation."""
    whole = combined(cells, dict(insertions()))
    return min(whole[START, end] for end in ENDS if (START, end) in whole)


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults laid in by the crc32 of conv_id:turn, and gone: whether a row is dropped.

    Of 20 remainders, 0 drops, 1 empties the text, 2 removes its [.!?], 3 repeats
    the row, 4 sets role user. Null roles and texts become one space, null ids and
    turns count as one in the key but stay null.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(h == 4, "user").otherwise(said("role"))
    copies = F.sequence(F.lit(1), F.when(h == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (h == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def examine(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone, with place (from 0, by turn, nulls first, then role and text), fault, illegal and new_turn.

    Rows that are gone come last and have no faults. fault is the first of blank,
    duplicate (role and text seen before) and truncated, else empty; illegal tells
    that the role may not follow the one before.
    """
    given = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.col("gone") if "gone" in rows.columns else F.lit(False).alias("gone"))
    order = Window.partitionBy("conv_id").orderBy("gone", F.asc_nulls_first("turn"), "role", "text")
    placed = given.withColumns({"place": F.row_number().over(order) - 1, "before": F.lag(F.substring("role", 1, 1)).over(order), "turn_before": F.lag("turn").over(order)})
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("place"))
    fault = F.when(F.col("gone"), "").when(~F.col("text").rlike(BLANK), "blank").when(F.col("seen") > 1, "duplicate").when(~F.col("text").rlike(ENDED), "truncated").otherwise("")
    pair = F.concat("before", F.substring("role", 1, 1))
    illegal = ~F.col("gone") & F.col("before").isNotNull() & ~pair.isin("su", "ua", "au")
    new_turn = ~F.col("gone") & F.col("turn").isNotNull() & ~F.coalesce(F.col("turn_before") == F.col("turn"), F.lit(False))
    return placed.withColumn("seen", seen).select("conv_id", "turn", "role", "text", "gone", "place", fault.alias("fault"), illegal.alias("illegal"), new_turn.alias("new_turn"))


CELL = "struct<p:int,r:int,cost:long,audit:string>"
SUMS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _cells(frame: DataFrame, items: str, of) -> DataFrame:
    """``frame`` with the column ``items`` replaced by the cells that ``of`` makes of it."""
    kept = [c for c in frame.columns if c != items]
    fields = ", ".join([*(f"{c} {frame.schema[c].dataType.simpleString()}" for c in kept), f"cells array<{CELL}>"])
    kind = pa.list_(pa.struct([("p", pa.int32()), ("r", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"p": p, "r": r, "cost": x, "audit": a} for (p, r), (x, a) in of(row).items()] for row in batch.column(items).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, kind)], [*kept, "cells"])

    return frame.mapInArrow(lean(run), fields)


def parse(examined: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Each conversation's gaps, numbers of faults, least cost and audit; a conversation whose rows are all gone has zeros and an empty audit."""
    count = lambda c: F.count_if(c).alias
    fault = lambda name: F.count_if(F.col("fault") == name).alias(name)
    there = ~F.col("gone")
    own = F.struct("place", F.substring("role", 1, 1).alias("initial"), "fault")
    leaves = examined.groupBy("conv_id", F.when(there, F.floor(F.col("place") / block)).otherwise(0).alias("block")).agg(
        *(fault(name) for name in ("blank", "duplicate", "truncated")), count(F.col("illegal"))("illegal"), count(F.col("new_turn"))("turns"),
        F.min(F.when(there, F.col("turn"))).alias("first_turn"), F.max(F.when(there, F.col("turn"))).alias("last_turn"), F.array_sort(F.collect_list(F.when(there, own))).alias("rows"),
    )
    spans = materialise(_cells(leaves, "rows", lambda rows: together([dict(_row(r["initial"], r["fault"])) for r in rows])))
    while spans.filter("block > 0").count():
        more = spans.groupBy("conv_id", F.floor(F.col("block") / fan).alias("block")).agg(
            *(F.sum(c).alias(c) for c in SUMS), F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), "cells"))).alias("spans"),
        )
        joined = lambda spans: together([{(c["p"], c["r"]): (c["cost"], c["audit"]) for c in s["cells"]} for s in spans])
        before, spans = spans, materialise(_cells(more, "spans", joined))
        release(before)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [cheapest({(c["p"], c["r"]): (c["cost"], c["audit"]) for c in cells}) for cells in batch.column("cells").to_pylist()]
            columns = [*(batch.column(c) for c in ("conv_id", "gaps", *SUMS[:4])), pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "gaps", *SUMS[:4], "cost", "audit"])

    gaps = F.coalesce((F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).cast("long"), F.lit(0).cast("long"))
    numbers = ", ".join(f"{c} long" for c in ("gaps", *SUMS[:4], "cost"))
    return spans.withColumn("gaps", gaps).mapInArrow(lean(end), f"conv_id {examined.schema['conv_id'].dataType.simpleString()}, {numbers}, audit string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, object, str, str, str]]:
    """Turns of each conversation after its edits, from its audit (place -1) and its rows behind it: (new conversation, conv_id, role, text, edit)."""
    key, audit, at, user, fresh = None, "", 0, False, True

    def inserted() -> Iterator[tuple[bool, object, str, str, str]]:
        nonlocal at, user, fresh
        while at < len(audit) and audit[at] == "I":
            user = not user
            yield fresh, key, "user" if user else "assistant", "", "I"
            at, fresh = at + 1, False

    for batch in batches:
        for conv, place, role, text, edits in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text", "audit")), strict=True):
            if place < 0:
                yield from inserted()
                key, audit, at, user, fresh = conv, edits, 0, False, True
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                user = not user
                role = "user" if user else "assistant"
            else:
                user = role[0] == "u"
            yield fresh, key, role, text, edit
            fresh = False
    yield from inserted()


def _passing(examined: DataFrame, parsed: DataFrame) -> DataFrame:
    """Audits and rows of each conversation, in order, in one partition."""
    rows = examined.filter(~F.col("gone")).select("conv_id", "place", "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = parsed.select("conv_id", F.lit(-1).alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    return rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "place")


def repaired(examined: DataFrame, parsed: DataFrame) -> DataFrame:
    """The turns after the edits: conv_id, place (from 0), role, text and edit (K, R or I)."""
    kind = examined.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows, place = ("conv_id", "place", "role", "text", "edit"), [], 0
        types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string()]
        made = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for fresh, key, role, text, edit in _edited(batches):
            place = 0 if fresh else place + 1
            rows.append((key, place, role, text, edit))
            if len(rows) >= 4096:
                yield made()
                rows = []
        if rows:
            yield made()

    return _passing(examined, parsed).mapInArrow(lean(run), f"conv_id {kind.simpleString()}, place long, role string, text string, edit string")


def digests(examined: DataFrame, parsed: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, of role:text of its repaired turns, joined by newlines; conversations without turns have no row."""
    kind = examined.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, last, sha = [], [], None, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array(keys, to_arrow_type(kind)), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
        for fresh, key, role, text, _ in _edited(batches):
            if fresh:
                if sha:
                    keys.append(last)
                    found.append(sha.hexdigest())
                last, sha = key, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if len(keys) >= 4096:
                yield made()
                keys, found = [], []
        if sha:
            keys.append(last)
            found.append(sha.hexdigest())
            yield made()

    return _passing(examined, parsed).mapInArrow(lean(run), f"conv_id {kind.simpleString()}, repaired_sha256 string")


def duckdb_sql() -> str:
    """The results of the query as DuckDB SQL: the crc32 by its table, the cheapest edits by one pass from turn to turn over the states of the form."""
    least = lambda *cells: f"list_sort([{', '.join(cells)}])[1]"
    plus = lambda cell, cost, edit: f"{{'c': {cell}.c + {cost}, 'a': {cell}.a || '{edit}'}}"
    never = "{'c': CAST(1000000000 AS BIGINT), 'a': ''}"
    dead, keep = "fault IN ('blank', 'duplicate')", lambda initial, cells: f"CASE WHEN i = '{initial}' AND fault NOT IN ('blank', 'duplicate') THEN {least(*cells)} ELSE {never} END"
    cut = f"CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END"
    users = [plus(c, cut, "K") for c in ("z", "s", "a")]
    renamed = [plus(c, f"{RENAME} + {cut}", "R") for c in ("z", "s", "a")]
    either = lambda cells: f"CASE WHEN {dead} THEN {never} ELSE {least(*cells)} END"
    step = f"""SELECT dp.conv_id, f.place, {plus("z", DELETE, "D")} AS z, {least(plus("s", DELETE, "D"), keep("s", [plus("z", cut, "K")]))} AS s,
        {least(plus("u", DELETE, "D"), keep("u", users), either(renamed))} AS u, {least(plus("a", DELETE, "D"), keep("a", [plus("u", cut, "K")]), either([plus("u", f"{RENAME} + {cut}", "R")]))} AS a
        FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.place = dp.place + 1"""
    first = f"SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS place, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS z, {never} AS s, {never} AS u, {never} AS a FROM conversations"
    closed = lambda cells: f"SELECT conv_id, place, z, s, u1 AS u, {least('a', plus('u1', INSERT, 'I'))} AS a FROM (SELECT *, {least('u', *(plus(c, INSERT, 'I') for c in ('z', 's', 'a')))} AS u1 FROM ({cells}))"
    space = r"\x20\x09-\x0D"
    return rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT)) AS codes FROM conversations),
hashed AS (SELECT keyed.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), codes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS h FROM keyed, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE h <> 0),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged),
f AS MATERIALIZED (SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before,
    CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][{space}]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
sums AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
dp AS ({closed(first)} UNION ALL {closed(step)}),
best AS (SELECT conv_id, {least("z", "a")} AS e FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1),
letters AS (SELECT conv_id, unnest(string_split(e.a, '')) AS edit, generate_subscripts(string_split(e.a, ''), 1) AS n FROM best WHERE e.a <> ''),
turns AS (SELECT *, CAST(sum(CAST(edit <> 'I' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY n) AS BIGINT) AS place, sum(CAST(edit <> 'D' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY n) - 1 AS no FROM letters),
kept AS (SELECT t.conv_id, t.n, edit, no, role, text, CAST(first_value(edit = 'K' AND i = 's') OVER (PARTITION BY t.conv_id ORDER BY t.n) AS INTEGER) AS system FROM turns t LEFT JOIN f ON edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.place = t.place WHERE edit <> 'D'),
whole AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (no - system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY n) AS said FROM kept GROUP BY 1)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.c AS cost, e.a AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM best b LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM b.conv_id
"""
