"""Periodic runs of words: maximal repetitions, and texts without them.

A run is a stretch of words with smallest period q, at least twice as long as q,
that no neighbouring word extends. Every run holds a pair (i, i + p) of equal
words with i on the grid 0, p, 2p, ... of its period p, so the grids of all
periods, n / 1 + n / 2 + ... pairs, find all runs. From each pair the run is
grown to both sides by longest common extensions.

An extension of (i, j) compares words directly until i + d and j + d both lie in
a difference cover, fewer than ``COVER`` words; only then the order of the
suffixes is asked, and only the suffixes that start in the cover are sorted:
the least common prefix of two of them is a range minimum of a sparse table.

The words of many documents are laid end to end, with a mark of its own after
each, so that numpy works on whole batches. A document is never cut; memory
grows with the words of a batch or of the longest document in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.words import lean, split_words

#: Words of a batch, unless one document has more.
LAID_WORDS = 1 << 18
#: Pairs that are grown at once, and bytes of text that are words at once.
PAIRS, PIECE_BYTES = 1 << 20, 1 << 22
RUNS = "array<struct<start:long,length:long,period:long>>"


def _difference_cover(q: int) -> tuple[int, list[int]]:
    """q * q + q + 1 and a least set of q + 1 residues whose differences are all residues, for a prime q, found by backtracking."""
    v = q * q + q + 1

    def grow(found: list[int], seen: set[int]) -> list[int] | None:
        if len(found) == q + 1:
            return found
        for x in range(found[-1] + 1, v):
            new = {d for y in found for d in ((x - y) % v, (y - x) % v)}
            if len(new) == 2 * len(found) and not new & seen and (end := grow([*found, x], seen | new)):
                return end
        return None

    return v, grow([0, 1], {1, v - 1})


COVER, RESIDUES = _difference_cover(5)
IN_COVER = np.isin(np.arange(COVER), RESIDUES)
#: By residues of i and j: the least d with i + d and j + d in the cover.
TO_COVER = np.array([[next(d for d in range(COVER) if IN_COVER[(i + d) % COVER] and IN_COVER[(j + d) % COVER]) for j in range(COVER)] for i in range(COVER)], np.int64)


class SampledSuffixes:
    """Order of the suffixes that start in the cover, with range minima of their common prefixes.

    ``words`` has a mark that is found nowhere else after each document, and
    ``COVER`` different ones at the end; ``wanted`` tells the places of the
    documents that are asked for.
    """

    def __init__(self, words: np.ndarray, wanted: np.ndarray):
        self.words, size = words, len(words) - COVER
        places = np.flatnonzero(IN_COVER[np.arange(size) % COVER] & wanted[:size])
        # any order of the blocks will do, as long as equal ones are one
        blocks = np.lib.stride_tricks.sliding_window_view(words, COVER)[places]
        _, names = np.unique(np.ascontiguousarray(blocks).view(np.dtype((np.void, COVER * words.itemsize))).ravel(), return_inverse=True)
        at = np.full(len(words), -1, np.int64)
        at[places] = np.arange(len(places))
        levels, width = [names.astype(np.int64)], COVER
        while len(places) and levels[-1].max() + 1 < len(places):
            further = places + width
            follows = np.where(further < size, at[np.minimum(further, size)], -1)
            pair = levels[-1] * (len(places) + 1) + np.where(follows >= 0, levels[-1][follows] + 1, 0)
            levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
            width *= 2
        self.rank = np.full(len(words), -1, np.int64)
        self.rank[places] = levels[-1]
        order = np.empty(len(places), np.int64)
        order[levels[-1]] = places
        self.table = [self._neighbours(order, levels, at)]
        step = 1
        while 2 * step <= len(self.table[0]):
            self.table.append(np.minimum(self.table[-1][:-step], self.table[-1][step:]))
            step *= 2

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Words that each suffix has in common with the next one, by whole blocks and then word by word."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = at[a], at[b]
            same = (x >= 0) & (y >= 0)
            same[same] = levels[k][x[same]] == levels[k][y[same]]
            for end in (a, b, common):
                end[same] += COVER << k
        going = np.arange(len(a))
        while len(going):
            going = going[self.words[a[going]] == self.words[b[going]]]
            for end in (a, b, common):
                end[going] += 1
        return common

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Least common prefixes of suffixes in the cover, i != j."""
        x, y = self.rank[i], self.rank[j]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(i), np.int64)
        for k in np.unique(level):
            of = level == k
            found[of] = np.minimum(self.table[k][low[of]], self.table[k][high[of] - (1 << k)])
        return found


class Extensions:
    """Longest common extensions within a batch of documents."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.words, self.doc, self.suffixes = words, doc, None

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j, i < j, have in common; the marks end them."""
        due = TO_COVER[i % COVER, j % COVER]
        found, going = np.zeros(len(i), np.int64), np.arange(len(i))
        ready = []
        for d in range(COVER):
            here = due[going] == d
            ready.append(going[here])
            going = going[~here]
            going = going[self.words[i[going] + d] == self.words[j[going] + d]]
            found[going] += 1
        left = np.concatenate(ready)
        if len(left):
            a, b = i[left] + found[left], j[left] + found[left]
            if self.suffixes is None:
                wanted = np.zeros(self.doc.max() + 1, bool)
                wanted[self.doc[a]] = True
                self.suffixes = SampledSuffixes(self.words, wanted[self.doc])
                self.known = wanted
            elif not self.known[self.doc[a]].all():
                self.suffixes, self.known = SampledSuffixes(self.words, np.ones(len(self.words), bool)), np.ones_like(self.known)
            found[left] += self.suffixes.common(a, b)
        return found


def _laid(documents: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, documents and starts of the documents, laid end to end with a mark after each."""
    sizes = np.array([len(d) for d in documents], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    words = np.empty(starts[-1] + COVER, np.int32)
    for k, d in enumerate(documents):
        words[starts[k] : starts[k] + sizes[k]] = d
        words[starts[k] + sizes[k]] = -1 - k
    words[starts[-1] :] = -1 - len(documents) - np.arange(COVER)
    doc = np.concatenate([np.repeat(np.arange(len(documents)), sizes + 1), np.full(COVER, len(documents))])
    return words, doc, starts[:-1]


def runs_of(documents: list[list[int]], least: int = 12) -> list[np.ndarray]:
    """Rows (start, length, period) of each document's runs of ``least`` words or more, by start, then period.

    Documents are lists of word numbers.
    """
    words, doc, starts = _laid(documents)
    n, longest = len(words) - COVER, max(map(len, documents), default=0)
    # the documents turned round, each in its place
    ends = starts + np.array(list(map(len, documents)), np.int64)
    places = np.flatnonzero(words[:n] >= 0)
    turned = words.copy()
    turned[(starts + ends)[doc[places]] - 1 - places] = words[places]
    forward, backward = Extensions(words, doc), Extensions(turned, doc)

    def stretches(i: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Start, end and period of what is long enough around the pairs (i, i + p)."""
        ahead = forward.common(i, i + p)
        # a pair that is no run's first on the grid is found from the one before, so fewer than p words lie behind
        may = ahead + p - 1 >= np.maximum(p, least - p)
        i, p, ahead = i[may], p[may], ahead[may]
        mirror = (starts + ends)[doc[i]]
        behind = backward.common(mirror - i - p, mirror - i)
        full = ahead + behind >= np.maximum(p, least - p)
        return np.unique(np.stack([i - behind, i + p + ahead, p], 1)[full], axis=0)

    found, grid, waiting = [np.zeros((0, 3), np.int64)], [], 0
    for p in range(1, longest // 2 + 1):
        # a mark is equal to no word
        hits = np.flatnonzero(words[: n - p : p] == words[p:n:p]) * p
        hits = hits[doc[hits] == doc[hits + p]]
        grid.append((hits, np.full(len(hits), p)))
        waiting += len(hits)
        if waiting > PAIRS or p == longest // 2:
            found.append(stretches(*map(np.concatenate, zip(*grid, strict=True))))
            grid, waiting = [], 0
    start, end, p = np.concatenate(found).T
    # one stretch has many multiples of its smallest period
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    rows = np.stack([start[first], (end - start)[first], p[first]], 1)
    owner = doc[rows[:, 0]] if len(rows) else np.zeros(0, np.int64)
    rows[:, 0] -= starts[owner] if len(rows) else 0
    by_start = np.lexsort((rows[:, 2], rows[:, 0], owner))
    rows, owner = rows[by_start], owner[by_start]
    return np.split(rows, np.searchsorted(owner, np.arange(1, len(documents)))) if documents else []


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word is in no run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges)[:n] == 0


def find(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """``docs`` with n_words, runs (array<struct<start, length, period>>, by start, then period) and kept: the words that no run repeats, joined by one space.

    Words are the maximal runs of characters outside [\\x20\\x09-\\x0D]. A null text counts
    as empty and has no words and runs; repeated rows stay; every other column
    passes through (columns of these three names are replaced).
    """
    carried = [c for c in docs.columns if c not in ("n_words", "runs", "kept")]
    fields = [f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in carried]

    def grown(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [split_words(t) for t in batch.column(text).to_pylist()]
        found: list[np.ndarray | None] = [None] * len(texts)
        # documents of like lengths go together, as the longest tells how many grids there are
        order, at = sorted(range(len(texts)), key=lambda k: len(texts[k])), 0
        while at < len(order):
            number: dict[bytes, int] = {}
            chosen, total = [], 0
            while at < len(order) and (not chosen or total + len(texts[order[at]]) <= LAID_WORDS):
                chosen.append(order[at])
                total += len(texts[order[at]])
                at += 1
            for k, rows in zip(chosen, runs_of([[number.setdefault(w, len(number)) for w in texts[k]] for k in chosen], least), strict=True):
                found[k] = rows
        kept = [b" ".join(w) if not len(r) else b" ".join([w[k] for k in np.flatnonzero(_kept(len(w), r))]) for w, r in zip(texts, found, strict=True)]
        rows = np.concatenate([*found, np.zeros((0, 3), np.int64)])
        items = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], ["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)), items)
        columns = [batch.column(c) for c in carried]
        return pa.RecordBatch.from_arrays([*columns, pa.array([len(w) for w in texts], pa.int64()), runs, pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())], [*carried, "n_words", "runs", "kept"])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)) // PIECE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
            yield from (grown(batch.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)

    return docs.select(*{*carried, text} if text not in carried else carried).mapInArrow(lean(batches), ", ".join([*fields, "n_words long", f"runs {RUNS}", "kept string"]))


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a repetition laid into every tenth text, chosen by the crc32 of its id; other texts, and rows without an id, stay as they are."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def laid(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x)), " ")

    return docs.withColumn(text, F.when(h % 10 == 0, _bound(words, lambda w: F.when(F.size(w) > 0, laid(w)).otherwise(F.col(text)))).otherwise(F.col(text)))


def longest(runs: Column) -> Column:
    """The run of greatest length; of several the one that starts first, then of least period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def listed(runs: Column) -> Column:
    """start,length,period and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
