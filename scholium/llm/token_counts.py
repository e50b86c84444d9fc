"""Token counts of document sections by offset-mapped attribution.

A document is encoded once, as a whole. Its tokens' character spans are joined
with the spans of its sections, and a token that crosses a boundary is
allocated by a rule: ``first`` (the section of its first character), ``most``
(the section with most of its characters, the earlier of equals) or ``shares``
(every section, by its share of the characters). The counts of a document's
sections always add up to its tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.words import lean

RULES = ("first", "most", "shares")

_encodings: dict[tuple[str, str], object] = {}


def encoding(ranks_path: str, pattern: str):
    """The byte-level BPE of a tiktoken rank file, once per worker."""
    import tiktoken

    if (ranks_path, pattern) not in _encodings:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        made = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _encodings[ranks_path, pattern] = (made, sizes)
    return _encodings[ranks_path, pattern]


def token_spans(text: str, ranks_path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in characters; the bytes of one character that are split over tokens give each of them that character."""
    made, sizes = encoding(ranks_path, pattern)
    ends = np.cumsum(sizes[np.array(made.encode_ordinary(text), np.int64)])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    if len(text) != (ends[-1] if len(ends) else 0):
        begins = (np.frombuffer(text.encode("utf-8", "replace"), np.uint8) & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(begins)])  # characters begun before each byte
        starts, ends = before[starts + 1] - 1, before[ends]
    return starts, ends


def line_sections(text: str) -> np.ndarray:
    """Starts of the sections of a text: its lines, each with its newline."""
    marks = [0]
    at = text.find("\n")
    while 0 <= at < len(text) - 1:
        marks.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(marks, np.int64)


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section under ``rule``, and how many of the tokens that touch it cross a boundary."""
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.maximum(np.searchsorted(sections, ends - 1, "right") - 1, first)
    crossing = np.flatnonzero(last > first)
    counts = np.bincount(first, minlength=len(sections)).astype(np.float64)
    crossed = np.zeros(len(sections), np.int64)
    limits = np.append(sections, size)
    for t in crossing:  # few: the tokens over a boundary
        own = np.arange(first[t], last[t] + 1)
        crossed[own] += 1
        parts = np.minimum(limits[own + 1], ends[t]) - np.maximum(limits[own], starts[t])
        if rule == "most":
            counts[first[t]] -= 1
            counts[own[int(np.argmax(parts))]] += 1
        elif rule == "shares":
            counts[first[t]] -= 1
            counts[own] += parts / parts.sum()
    return counts, crossed


def count_sections(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "first", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of each section (line) of each document.

    Returns key, section (from 0), start and stop (characters, the newline
    included), n_tokens (double under ``shares``, else long), n_crossing and
    doc_tokens. A null text counts as empty; an empty text has one section of
    no tokens; repeated rows each give their sections; other columns are not
    read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema[key].dataType.simpleString()
    number = "double" if rule == "shares" else "long"
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 500):
                some = batch.slice(begin, 500)
                parts, rows = [], []
                for i, t in enumerate(some.column("text").to_pylist()):
                    sections = line_sections(t)
                    starts, ends = token_spans(t, ranks_path, pattern)
                    counts, crossed = allocate(starts, ends, sections, len(t), rule)
                    n = len(sections)
                    rows.append(np.full(n, i))
                    parts.append((np.arange(n), sections, np.append(sections[1:], len(t)), counts, crossed, np.full(n, len(starts))))
                section, start, stop, counts, crossed, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
                keys = some.column("key").take(pa.array(np.concatenate(rows)))
                amounts = counts if number == "double" else counts.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(section, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(amounts), pa.array(crossed, pa.int64()), pa.array(whole, pa.int64())],
                    ["key", "section", "start", "stop", "n_tokens", "n_crossing", "doc_tokens"],
                )

    out = rows.mapInArrow(lean(count), f"key {kind}, section long, start long, stop long, n_tokens {number}, n_crossing long, doc_tokens long")
    return out.withColumnRenamed("key", key)
