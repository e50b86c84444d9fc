"""Removal of repeated word windows, exactly, by super-k-mer partitioning.

A window is ``window`` consecutive words; its minimiser is the least hash of
its ``GRAM``-word grams. Consecutive windows with the same minimiser form a
super-k-mer. Equal windows have equal minimisers, so a window can only repeat
if its minimiser occurs in two super-k-mers, or twice in one text: minimisers
are counted first, and only super-k-mers whose minimiser recurs travel. Each travels as one packed
string of words to the bucket of its minimiser, where the windows are sorted
and counted.

Minimisers of more than ``HOT`` super-k-mers (passages that very many documents
share) have no bucket: equal strings are counted first, with partial
aggregation, and the windows of the distinct ones by a 128-bit digest, so no
task gathers them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.words import gram_hashes, lean, packed_texts, row_keys, sliding_min, split_words, unpack, word_hashes
from scholium.session import materialise

WINDOW = 35
GRAM = 8
HOT = 200
#: Windows in a super-k-mer at most; a long run of one minimiser is cut.
RUN = 64


def super_kmers(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Minimiser, first word and number of words of each super-k-mer, and whether its minimiser recurs in the text."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    grams = gram_hashes(word_hashes(words), gram)
    least = sliding_min(grams, window - gram + 1)
    ordered = np.sort(grams)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    sizes = np.diff(np.append(change, len(least)))
    if sizes.max() > RUN:
        change = np.unique(np.concatenate([np.arange(a, a + n, RUN) for a, n in zip(change, sizes, strict=True)]))
        sizes = np.diff(np.append(change, len(least)))
    mini = least[change]
    return mini.view(np.int64), change, sizes + window - 1, np.isin(mini, again)


def repeated_windows(groups: np.ndarray, texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Super-k-mer and window offset of every window that occurs twice or more in its group.

    Windows are sorted by group and hash; neighbours of equal hash are compared
    as words, and runs in which they differ are sorted by words.
    """
    split = [t.split(b" ") for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    words = word_hashes([w for own in split for w in own])
    hashes = gram_hashes(words, window)
    firsts = np.cumsum(counts) - counts
    windows = counts - window + 1
    owner = np.repeat(np.arange(len(texts)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    own_hash = hashes[firsts[owner] + offset]
    own_group = groups[owner]
    order = np.lexsort((own_hash, own_group))
    same = (own_hash[order][1:] == own_hash[order][:-1]) & (own_group[order][1:] == own_group[order][:-1])
    flagged = np.zeros(len(owner), bool)
    starts = np.flatnonzero(np.concatenate([[False], same]) != np.concatenate([same, [False]]))
    for a, b in zip(starts[::2], starts[1::2] + 1, strict=True):
        run = order[a:b]
        slices = [split[owner[i]][offset[i] : offset[i] + window] for i in run]
        if all(s == slices[0] for s in slices[1:]):
            flagged[run] = True
        else:
            seen: dict[tuple, list[int]] = {}
            for i, s in zip(run, slices, strict=True):
                seen.setdefault(tuple(s), []).append(i)
            for equal in seen.values():
                flagged[equal] = len(equal) > 1
    found = np.flatnonzero(flagged)
    return owner[found], offset[found]


def _ranges(owner: np.ndarray, offset: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge consecutive windows of one owner: owner, first word, end word."""
    if not len(owner):
        return owner, offset, offset
    cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)]))
    last = np.append(cut[1:] - 1, len(owner) - 1)
    return owner[cut], offset[cut], offset[last] + window


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Remove every word covered by a window that also starts anywhere else.

    Returns key, n_words, n_removed and kept (the kept words joined by one
    space). A null or empty text has no words. Repeated rows count as
    occurrences of their windows, each gives a row. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    gram = min(gram, window)
    rows = docs.select(*row_keys(key, text), F.col(text).alias("text"))

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [super_kmers(split_words(t), window, gram) for t in batch.column("text").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(batch)), [len(f[0]) for f in found]))
            mini, start, size, again = (np.concatenate([f[i] for f in found]) for i in range(4))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("row").take(at), pa.array(mini), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(again)], ["key", "row", "mini", "start", "size", "again"])

    # 35 words and more: shorter texts have no window and need no task
    met = materialise(rows.filter(F.length("text") >= 2 * window - 1).mapInArrow(lean(minimisers), f"key {kind}, row binary, mini long, start int, size int, again boolean"))
    recurring = met.groupBy("mini").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).filter((F.col("n") > 1) | F.col("again")).select("mini", (F.col("n") > hot).alias("hot"))
    places = met.join(recurring, "mini").groupBy("key", "row").agg(F.collect_set(F.struct("start", "size", "mini", "hot")).alias("places"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                some = batch.slice(i, 200)
                at, out = [], []
                for k, (packed, own) in enumerate(zip(some.column("packed").to_pylist(), some.column("places").to_pylist(), strict=True)):
                    words = unpack(packed).split()
                    for p in own:
                        out.append((p["mini"], p["start"], b" ".join(words[p["start"] : p["start"] + p["size"]]), p["hot"]))
                        at.append(k)
                taken = pa.array(at, pa.int64())
                mini, start, string, often = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [some.column("key").take(taken), some.column("row").take(taken), some.column("copies").take(taken), pa.array(mini, pa.int64()), pa.array(start, pa.int32()), pa.array(string, pa.binary()), pa.array(often, pa.bool_())],
                    ["key", "row", "copies", "mini", "start", "string", "hot"],
                )

    texts = packed_texts(rows.filter(F.length("text") >= 2 * window - 1)).groupBy("key", "row").agg(F.first("packed").alias("packed"), F.count(F.lit(1)).alias("copies"))
    joined = texts.join(places, [texts["key"].eqNullSafe(places["key"]), texts["row"] == places["row"]]).select(texts["key"], texts["row"], "copies", "packed", "places")
    strings = materialise(joined.mapInArrow(lean(pack), f"key {kind}, row binary, copies long, mini long, start int, string binary, hot boolean"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            mini = held.column("mini").to_numpy()
            if len(mini) < 20_000:
                continue
            last = int(np.searchsorted(mini, mini[-1]))  # the last group may go on
            if last:
                yield counted(held.slice(0, last).combine_chunks())
                held = held.slice(last)
        if held is not None and len(held):
            yield counted(held.combine_chunks())

    def counted(table: pa.Table) -> pa.RecordBatch:
        # equal rows travel once; their windows occur as often as the rows
        copies = np.minimum(table.column("copies").to_numpy(), 2)
        index = np.repeat(np.arange(len(table)), copies)
        strings = table.column("string").to_pylist()
        owner, offset = repeated_windows(table.column("mini").to_numpy()[index], [strings[i] for i in index], window)
        owner, first, end = _ranges(owner, offset, window)
        owner = index[owner]
        start = table.column("start").to_numpy()[owner]
        at = pa.array(owner)
        columns = [table.column(c).combine_chunks().take(at) for c in ("key", "row")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(start + first, pa.int32()), pa.array(start + end, pa.int32())], ["key", "row", "first", "end"])

    # at most ``hot`` rows share a minimiser here
    buckets = strings.filter(~F.col("hot")).drop("hot").repartition("mini").sortWithinPartitions("mini")
    found = buckets.mapInArrow(lean(count), f"key {kind}, row binary, first int, end int").select("key", "row", F.array(F.struct("first", "end")).alias("ranges"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                some = batch.slice(i, 500)
                split = [t.split(b" ") for t in some.column("string").to_pylist()]
                counts = [len(w) - window + 1 for w in split]
                digests = [hashlib.blake2b(b" ".join(w[j : j + window]), digest_size=16).digest() for w, n in zip(split, counts, strict=True) for j in range(n)]
                at = pa.array(np.repeat(np.arange(len(some)), counts))
                yield pa.RecordBatch.from_arrays([some.column("id").take(at), some.column("n").take(at), pa.array(np.concatenate([np.arange(n) for n in counts]), pa.int32()), pa.array(digests, pa.binary())], ["id", "n", "at", "digest"])

    # a string met twice repeats as a whole; of the others, the windows met anywhere else
    often = strings.filter("hot").withColumn("id", F.md5("string"))
    distinct = materialise(often.groupBy("id", "string").agg(F.sum("copies").alias("n")))
    cut = distinct.mapInArrow(lean(windows), "id string, n long, at int, digest binary")
    twice = cut.groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") > 1).select("digest")
    partly = cut.filter(F.col("n") == 1).join(twice, "digest").groupBy("id").agg(F.collect_list(F.struct(F.col("at").alias("first"), (F.col("at") + window).alias("end"))).alias("ranges"))
    wholly = distinct.filter(F.col("n") > 1).select("id", F.array(F.struct(F.lit(0).alias("first"), F.size(F.split(F.col("string").cast("string"), " ")).alias("end"))).alias("ranges"))
    moved = F.transform("ranges", lambda r: F.struct((F.col("start") + r["first"]).alias("first"), (F.col("start") + r["end"]).alias("end")))
    common = often.join(partly.unionByName(wholly), "id").select("key", "row", moved.alias("ranges"))
    ranges = found.unionByName(common).groupBy("key", "row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                some = batch.slice(i, 500)
                counts, removed, kept = [], [], []
                for packed, own in zip(some.column("packed").to_pylist(), some.column("ranges").to_pylist(), strict=True):
                    words = unpack(packed).split()
                    counts.append(len(words))
                    if own:
                        gone = np.zeros(len(words) + 1, np.int64)
                        np.add.at(gone, [r["first"] for r in own], 1)
                        np.add.at(gone, [r["end"] for r in own], -1)
                        stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                        removed.append(len(words) - len(stay))
                        words = [words[k] for k in stay.tolist()]
                    else:
                        removed.append(0)
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([some.column("key"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["key", "n_words", "n_removed", "kept"])

    whole = packed_texts(rows)
    marked = whole.join(ranges, [whole["key"].eqNullSafe(ranges["key"]), whole["row"] == ranges["row"]], "left").select(whole["key"], "packed", "ranges")
    return marked.mapInArrow(lean(strip), f"key {kind}, n_words long, n_removed long, kept string").withColumnRenamed("key", key)
