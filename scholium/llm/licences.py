"""Licence scans: notice phrases and identifier tags by Aho-Corasick, licence expressions by a shunting yard.

A text is turned into its words (A-Z lower-cased) once. One automaton over the
words finds the phrases that name a licence, the phrases that grant one, and the
tags that announce an expression. Behind a tag the text itself is read on to the
end of the line, and its longest part that is an expression (licence names,
and/or/with, brackets) is evaluated: names to labels, and the whole to how much
it restricts, where ``or`` takes the milder side, ``and`` the stricter one, and
``with`` an exception that makes its licence one step milder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.words import lean

# fixed values: the base phrases and their labels
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
PHRASES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "gnu gpl": "gpl", "mozilla public license": "mpl", "eclipse public license": "epl", "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd",
    "isc license": "isc", "zlib license": "zlib", "boost software license": "bsl", "the unlicense": "unlicense", "cc0": "cc0", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "released into the public domain": "public-domain", "all rights reserved": "all-rights-reserved",
}
GRANTS = ("licensed under", "released under", "distributed under", "available under", "under the terms of", "subject to the terms of", "copyright")
TAGS = ("spdx license identifier", "license expression", "license", "licence")
#: A licence named so few words after the end of a grant is granted.
GRANT_WORDS = 4
#: How much each kind of evidence makes it likely that the text stands under a licence.
TAGGED, GRANTED, NAMED = 0.9, 0.8, 0.4
#: Steps of restriction: none, notice to be kept, changes to be shared, uses forbidden.
STEPS = {"cc0": 0, "unlicense": 0, "public-domain": 0, "zlib": 1, "mit": 1, "isc": 1, "bsd": 1, "bsl": 1, "apache": 1, "cc-by": 1, "mpl": 2, "epl": 2, "lgpl": 2, "gpl": 2, "agpl": 2, "cc-by-sa": 2, "cc-by-nc": 3, "cc-by-nd": 3, "cc-by-nc-sa": 3, "cc-by-nc-nd": 3, "all-rights-reserved": 3}
UNKNOWN_STEP = 3

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(rb"[()]|[A-Za-z0-9.+:-]+")
EXPRESSION_AT = re.compile(rb"[\"'\x20\t]*[:=][\"'\x20\t]*([A-Za-z0-9.+:()\x20\t-]*)")
VERSION = re.compile(r"(?:[-_ ]?v?[0-9]+(?:\.[0-9]+)*(?:-clause)?)?(?:-only|-or-later|\+)?$")
PIECE_BYTES = 1 << 22
TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
PLACES = "array<struct<label:string,word:long,n_words:long,base:boolean,granted:boolean>>"
EXPRESSIONS = "array<struct<expression:string,labels:array<string>,step:int>>"


def label(name: str) -> str | None:
    """The label of a licence name in an expression, without its version; null for a word that names none."""
    name = name.lower()
    if name.startswith("licenseref-"):
        return name
    plain = VERSION.sub("", name)
    return plain if plain in STEPS else None


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting yard: an expression in postfix order, null where it is none."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True
    for t in tokens:
        low = t.lower()
        if operand and t == "(":
            waiting.append(t)
        elif operand:
            # an exception is any name, a licence a known one
            if t == ")" or low in PRECEDENCE or not ((waiting and waiting[-1] == "with") or label(t)):
                return None
            out.append(low)
            operand = False
        elif t == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif low in PRECEDENCE:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[low]:
                out.append(waiting.pop())
            # an exception belongs to one licence
            if low == "with" and out[-1] in PRECEDENCE:
                return None
            waiting.append(low)
            operand = True
        else:
            return None
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(order: list[str]) -> tuple[list[str], int]:
    """Labels, sorted, and the step of restriction of an expression in postfix order."""
    stack: list[tuple[frozenset[str], int]] = []
    for t in order:
        if t not in PRECEDENCE:
            known = label(t)
            stack.append((frozenset([known] if known else []), STEPS.get(known, UNKNOWN_STEP)))
            continue
        (b, y), (a, x) = stack.pop(), stack.pop()
        stack.append((a, max(0, x - 1)) if t == "with" else (a | b, min(x, y) if t == "or" else max(x, y)))
    labels, step = stack[0]
    return sorted(labels), step


def parse(text: bytes) -> tuple[str, list[str], int] | None:
    """The longest start of ``text`` that is an expression, as (expression, labels, step)."""
    tokens = [t.decode() for t in TOKEN.findall(text)]
    # at most two operators between names, so the first pair of names ends what can be one
    end = 0
    depth, operand = 0, True
    ends = []
    for k, t in enumerate(tokens):
        low = t.lower()
        if t == "(" and operand:
            depth += 1
        elif t == ")" and not operand and depth:
            depth -= 1
        elif low in PRECEDENCE and not operand:
            operand = True
            continue
        elif t not in "()" and low not in PRECEDENCE and operand:
            operand = False
        else:
            break
        if not depth and not operand:
            ends.append(k + 1)
    for end in reversed(ends):
        order = postfix(tokens[:end])
        if order:
            said = " ".join(t.upper() if t.lower() in PRECEDENCE else t for t in tokens[:end]).replace("( ", "(").replace(" )", ")")
            return said, *evaluate(order)
    return None


def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    kinds = {p: ("base", x) for p, x in BASE_PHRASES.items()} | {p: ("named", x) for p, x in PHRASES.items()} | {p: ("grant", "") for p in GRANTS} | {p: ("tag", "") for p in TAGS}
    for phrase, (kind, name) in kinds.items():
        made.add_word(f" {phrase} ", (kind, name, phrase.count(" ") + 1, len(phrase) + 2))
    made.make_automaton()
    return made


def scan(text: str | None, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple], list[tuple], float]:
    """Number of words, places (label, word, n_words, base, granted), expressions and score of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    plain = raw.translate(TO_WORDS)
    words = plain.split()
    # each byte is one character, as the phrases are ASCII
    line = b"".join((b" ", b" ".join(words), b" ")).decode("latin-1")
    met = sorted((end + 1 - value[3], value) for end, value in automaton.iter(line))
    if not met:
        return len(words), [], [], 0.0
    found, grants, tags, at, before = [], set(), [], 0, 0
    for start, (kind, name, size, _) in met:
        before += line.count(" ", at, start)
        at = start
        if kind == "grant":
            grants.update(range(before + size, before + size + GRANT_WORDS + 1))
        elif kind == "tag":
            tags.append((before, before + size - 1))
        else:
            found.append((name, before, size, kind == "base"))
    places = [(*p, p[1] in grants) for p in found]
    expressions = []
    if tags:
        ends = {last for _, last in tags}
        spans = (m.end() for m in re.finditer(rb"[^ ]+", plain))
        behind = {k: end for k, end in enumerate(islice(spans, max(ends) + 1)) if k in ends}
        for last in sorted(ends):
            read = EXPRESSION_AT.match(raw, behind[last])
            if read and (parsed := parse(read[1])):
                expressions.append(parsed)
    doubt = 1.0
    for weight, there in ((TAGGED, bool(expressions)), (GRANTED, any(p[4] for p in places)), (NAMED, any(not p[4] for p in places))):
        doubt *= 1 - weight * there
    return len(words), places, expressions, round(1 - doubt, 4)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, places, expressions and licence_score.

    places: each phrase with its label, its first word (from 0), its number of
    words, whether it is a base phrase, and whether a grant stands before it.
    expressions: what stands behind each tag, with its labels and its step of
    restriction (0 none to 3 uses forbidden). The score is 0 without evidence.
    A null text counts as empty and has none; repeated rows stay; every other
    column passes through (columns of these names are replaced).
    """
    added = ("n_words", "places", "expressions", "licence_score")
    carried = [c for c in docs.columns if c not in added]
    fields = [f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in carried]
    places_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("base", pa.bool_()), ("granted", pa.bool_())]))
    expressions_type = pa.list_(pa.struct([("expression", pa.string()), ("labels", pa.list_(pa.string())), ("step", pa.int32())]))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in rows:
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
            start, waiting = 0, 0
            for k, size in enumerate([*sizes, PIECE_BYTES]):
                waiting += size
                if waiting < PIECE_BYTES:
                    continue
                end = min(k + 1, batch.num_rows)
                piece = batch.slice(start, end - start)
                start, waiting = end, 0
                if not piece.num_rows:
                    continue
                found = [scan(t, automaton) for t in piece.column(text).to_pylist()]
                places = [[dict(zip(("label", "word", "n_words", "base", "granted"), p, strict=True)) for p in f[1]] for f in found]
                expressions = [[dict(zip(("expression", "labels", "step"), e, strict=True)) for e in f[2]] for f in found]
                columns = [pa.array([f[0] for f in found], pa.int64()), pa.array(places, places_type), pa.array(expressions, expressions_type), pa.array([f[3] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in carried), *columns], [*carried, *added])

    return docs.select(*carried, *([] if text in carried else [text])).mapInArrow(lean(batches), ", ".join([*fields, "n_words long", f"places {PLACES}", f"expressions {EXPRESSIONS}", "licence_score double"]))


def joined(labels: Column) -> Column:
    """Labels, distinct, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
