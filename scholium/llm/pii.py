"""Personal data: patterns propose spans, checksums confirm, context scores.

Everything is DataFrame functions. A kind is a pattern with a validator and a
base score; words near a span raise its score. The base kinds (email, ip, card,
phone) are kept whenever their validator holds; the added kinds (iban, ssn,
secret, tel) need their checksum or enough context. Offsets are code points, end
exclusive.

The patterns propose the leftmost non-overlapping matches. Each begins with a
guard that lets a match start only where a run of its first class starts or
where the last match ended; greedy matches start nowhere else, and the guard
keeps the search linear on long runs. Possessive quantifiers stand where giving
back could never help.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS = 40
#: Spans are laid in blocks of so many, since a fold copies what it has laid for each span.
BLOCK = 128


def _guarded(first: str, pattern: str) -> str:
    return rf"(?:\G|(?<!{first})){pattern}"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str
    base: bool
    score: float
    words: tuple[str, ...]


# fixed values: the kinds, in the order in which spans are listed
KINDS = (
    Kind("email", _guarded(r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"), "@", True, 0.9, ("mail", "contact", "write")),
    Kind("ip", _guarded(r"[0-9]", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"), ".", True, 0.6, ("ip", "host", "server", "address")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", True, 0.7, ("card", "visa", "credit", "pay")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 0.7, ("phone", "call", "tel", "mobile", "fax")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "", False, 0.9, ("iban", "bank", "account")),
    Kind("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", "", False, 0.3, ("token", "secret", "api", "key", "passw", "bearer", "credential")),
    Kind("tel", r"(?<![0-9+()-])(?<!\+[0-9]{1,3}\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])", "", False, 0.3, ("phone", "call", "tel", "mobile", "fax")),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", False, 0.3, ("ssn", "social", "security", "tax")),
)
KEEP_SCORE = 0.5
CONTEXT_GAIN = 0.3


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _mod97(text: Column) -> Column:
    """Whether an IBAN's digits, letters as 10 to 35, leave 1 modulo 97."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    # split leaves no empty piece but perhaps the last
    values = F.filter(values, lambda v: v >= 0)
    rest = F.aggregate(values, F.lit(0), lambda a, v: F.when(v < 10, (a * 10 + v) % 97).otherwise((a * 100 + v) % 97))
    return (F.length(plain) >= 15) & (F.length(plain) <= 34) & (rest == 1)


def _ip_parts(text: Column) -> Column:
    """Whether no part is over 255, by its digits without leading zeros."""
    parts = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def valid(kind: str, text: Column) -> Column:
    """The validator of a kind, on the matched text."""
    n = F.length(digits(text))
    return {
        "email": F.lit(True),
        "ip": _ip_parts(text),
        "card": n.between(16, 19) & F.call_function("luhn_check", digits(text)),
        "phone": n.between(8, 15),
        "iban": _mod97(text),
        "ssn": F.lit(True),
        # a word or a number alone is no key
        "secret": text.rlike("[0-9]") & text.rlike("[A-Za-z]"),
        "tel": F.lit(True),
    }[kind]


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: arguments of a lambda are, columns are in each place that names them."""
    return F.transform(F.array(value), f)[0]


def _blocks(n: Column) -> Column:
    """0 to the number of the last block of ``n`` spans."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / BLOCK)).cast("int"))


def _spans(kind: Kind, text: Column) -> Column:
    """array<struct<kind, start, end, score>> of one kind, by place."""
    gaps = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    # a match starts after all gaps up to it and all matches before it
    n = F.size(found)
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), n).alias("gap"), found.alias("match"), F.slice(gaps, F.lit(2), n).alias("next"))
    empty = F.array().cast("array<struct<start:int,end:int,match:string,near:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        # the words around lie in the gaps, so no match reads the whole text again
        near = F.lower(F.concat(F.substring(x["gap"], -CONTEXT_CHARS, CONTEXT_CHARS), F.lit(" "), F.substring(x["next"], 1, CONTEXT_CHARS)))
        span = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), near.alias("near"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    block = lambda z, k: F.slice(z, k * BLOCK + 1, F.lit(BLOCK))
    lengths = lambda z: F.transform(_blocks(F.size(z)), lambda k: F.aggregate(block(z, k), F.lit(0), lambda a, x: a + F.length(x["gap"]) + F.length(x["match"])))

    def laid(z: Column, sizes: Column) -> Column:
        # each block begins where the lengths of all before it end
        begin = lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, x: a + x)
        return F.transform(sizes, lambda _, k: F.aggregate(block(z, k), F.struct(begin(k).alias("at"), empty.alias("spans")), step, lambda s: s["spans"]))

    placed = F.flatten(_bound(zipped, lambda z: _bound(lengths(z), lambda sizes: laid(z, sizes))))
    kept = F.filter(placed, lambda s: valid(kind.name, s["match"]))

    def scored(s: Column) -> Column:
        gain = F.when(s["near"].rlike(rf"\b(?:{'|'.join(kind.words)})"), CONTEXT_GAIN).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(F.lit(1.0), F.lit(kind.score) + gain).alias("score"))

    spans = F.transform(kept, scored)
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= KEEP_SCORE)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    proposed = text.rlike(kind.pattern)
    return F.when(F.contains(text, F.lit(kind.needs)) & proposed if kind.needs else proposed, spans).otherwise(none)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column spans: array<struct<kind, start, end, score>>.

    Spans are listed by kind (base kinds first), then by start. A null text
    counts as empty; empty texts have no spans; repeated rows stay; every other
    column passes through (a column named spans is replaced).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("spans", F.concat(*(_spans(kind, body) for kind in KINDS)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores(spans: Column) -> Column:
    """The score of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"], 2).cast("string")), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin([k.name for k in KINDS if k.base]))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by <KIND>; null stays null.

    Where spans of several kinds overlap, the one that starts first wins, then
    the longer, then the first kind listed.
    """
    name = "spans"
    while name in docs.columns:
        name += "_"
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn(name, F.concat(*(_spans(kind, body) for kind in KINDS)))
    order = F.lit([k.name for k in KINDS])
    ranked = F.array_sort(F.transform(name, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.array_position(order, s["kind"]).alias("rank"), s["kind"].alias("kind"))))

    def lay(spans: Column, state: Column, k: Column) -> Column:
        part = F.slice(spans, k * BLOCK + 1, F.lit(BLOCK))
        # the text of a block is cut once, and its pieces from that
        chunk = F.substring(body, state["at"] + 1, F.greatest(F.lit(0), F.element_at(part, -1)["start"] - state["at"]))

        def step(own: Column, s: Column, block: Column) -> Column:
            ahead = s["start"] >= own["at"]
            piece = F.concat(F.substring(block["chunk"], own["at"] - block["at"] + 1, s["start"] - own["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            return F.struct(F.when(ahead, -s["back"]).otherwise(own["at"]).alias("at"), F.when(ahead, F.concat(own["out"], F.array(piece))).otherwise(own["out"]).alias("out"))

        empty = F.array().cast("array<string>").alias("out")
        own = lambda block: F.aggregate(block["part"], F.struct(block["at"].alias("at"), empty), lambda o, s: step(o, s, block))
        added = lambda o: F.struct(o["at"].alias("at"), F.concat(state["out"], F.array(F.array_join(o["out"], ""))).alias("out"))
        return _bound(F.struct(part.alias("part"), chunk.alias("chunk"), state["at"].alias("at")), lambda block: _bound(own(block), added))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = _bound(ranked, lambda spans: F.aggregate(_blocks(F.size(spans)), start, lambda state, k: lay(spans, state, k), lambda s: F.concat(F.array_join(s["out"], ""), F.substring(body, s["at"] + 1, F.length(body)))))
    return found.withColumn(text, F.when(F.size(name) > 0, clean).otherwise(F.col(text))).drop(name)
