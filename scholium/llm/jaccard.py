"""N-gram Jaccard join by parity sketches, with the classes that it links.

A text's set of word n-grams is hashed into a sketch of parity bits: every
n-gram toggles one bit, so the Hamming distance of two sketches is at most the
symmetric difference of the sets. The sketch is cut into more blocks than sets
of this size may differ by if they link; two sets that link then agree in a
non-zero block, and sets are joined on (size band, block, value). A set takes
part in its own band and in the one below, since sets that link have sizes in
the same or in neighbouring bands. A block of many bits is kept as the XOR of
its bits' 64-bit marks. Candidates are verified on the sets themselves.

Equal sets are one node. A second sketch of fixed length prunes the candidates:
a pair whose sketches are farther apart than its sets may differ is no link.
What is left is verified on the sets themselves; the text of a node goes once
to all that are compared with it.

Within a group of equal blocks only stars are tested at first: all members
against the least, gathered per task before the shuffle. Groups whose members
still lie in several classes are tested against a hub, the member of the most
and largest groups. What is mixed after that is joined on the rarest blocks of a
finer sketch, between different classes only. No link between different classes
is left out, and the members of one class need no more links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.graph import components
from scholium.llm.words import gram_hashes, lean, mix, one_by_one, packed_texts, row_keys, unpack
from scholium.session import materialise, release

#: Block keys that a task gathers before it sends them, and those of one part.
BATCH_KEYS, PART_KEYS = 400_000, 500_000
HUB_ROUNDS = 2
#: Blocks of the finer sketch, times the difference allowed.
FINER = 3
#: 64-bit words of the parity sketch that prunes pairs.
SKETCH_WORDS = 16
#: Pairs of one node that share a copy of its text.
PAIRS = 500
LARGEST = 1 << 26


@cache
def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest size, symmetric difference allowed, and blocks, of each band.

    A few more blocks than needed: some are zero, and those do not count.
    """
    upper, size = [], 1
    while size < LARGEST:
        upper.append(100 * size // percent)
        size = upper[-1] + 1
    top = np.array(upper, np.int64)
    differ = (top + 100 * top // percent) * (100 - percent) // (100 + percent)
    return top, differ, differ + 5 + differ // 10


def ngrams(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one n-gram."""
    words = np.array(list(map(xxhash.xxh3_64_intdigest, text.lower().split())), np.uint64)
    return np.unique(gram_hashes(words, min(n, len(words)))) if len(words) else words


def identity(grams: np.ndarray, bits: int = 64, clashes: frozenset[int] = frozenset()) -> tuple[int, int]:
    """Node of a set, and a second digest; where unequal sets would be one node, the second digest is the node."""
    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    node, other = (int.from_bytes(d, "little", signed=True) for d in (digest[:8], digest[8:]))
    node >>= 64 - bits
    return (other, other) if node in clashes else (node, other)


def parity(grams: np.ndarray) -> np.ndarray:
    """Parity sketch of fixed length, as signed 64-bit words."""
    bits = 64 * SKETCH_WORDS
    return np.packbits(np.bincount((mix(grams) % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def banded_keys(grams: np.ndarray, percent: int, finer: int = 0) -> list[tuple[int, int, np.ndarray]]:
    """Band, difference allowed and keys of the non-zero blocks, for the set's own band and the one below.

    The lowest bit of a key's upper 48 is that of its band, so that the keys of the two bands can be told apart.
    """
    top, differ, blocks = bands(percent)
    own = int(np.searchsorted(top, len(grams)))
    marks, found = mix(grams), []
    for band in (own, own - 1):
        if band < 0 or not differ[band]:
            continue  # only equal sets link
        n = finer * int(differ[band]) if finer else int(blocks[band])
        # the n-grams are sorted, so those of a block, a range of hashes, are neighbours
        block = ((grams >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        values = np.bitwise_xor.reduceat(marks, first)
        full = values != 0
        salt = mix(np.array([band], np.uint64)) + block[first][full] * np.uint64(0xC2B2AE3D27D4EB4F)
        keys = mix(values[full] + mix(salt + np.uint64(1)))
        if len(keys) <= differ[band]:  # so few blocks may all differ: such sets of a band meet in one group
            keys = np.append(keys, mix(np.array([band], np.uint64) + np.uint64(1 << 40)))
        low = np.uint64(1 << 16)
        found.append((band, int(differ[band]), keys & ~low | low * np.uint64(band & 1)))
    return found


def block_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """All block keys of a set."""
    return np.concatenate([np.zeros(0, np.uint64), *(found[2] for found in banded_keys(grams, percent))])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of the run of equal values, for each, and the run's length."""
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    size = np.diff(np.append(start, len(values)))
    return np.repeat(start, size), np.repeat(size, size)


def _pack(keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """14 bytes for each entry: 48 bits of key, 64 of node."""
    out = np.empty((len(keys), 14), np.uint8)
    out[:, :6] = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6]
    out[:, 6:] = np.ascontiguousarray(nodes).view(np.uint8).reshape(-1, 8)
    return out


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 14)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, :6] = raw[:, :6]
    return keys.view(np.uint64).ravel(), np.ascontiguousarray(raw[:, 6:]).view(np.int64).ravel()


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct entries with the least node of their key and the size of its group."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])]) if len(keys) else np.zeros(0, bool)
    keys, nodes = keys[new], nodes[new]
    if not len(keys):
        return keys, nodes, nodes, nodes
    first, size = _runs(keys)
    return keys, nodes, nodes[first], size


def _dealt(keys: np.ndarray, packed: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    """Entries by part of their key."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    where, cut = np.unique(part[order], return_index=True)
    blob = packed[order]
    return where.tolist(), [blob[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(blob)), strict=True)]


def _columns(kind: int, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(x), 100_000):
        a, b = pa.array(x[i : i + 100_000].astype(np.int64)), pa.array(y[i : i + 100_000].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), a, b], ["kind", "x", "y"])


def _gathered(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and nodes of several sets together, in batches of bounded size."""
    keys, nodes, size = [], [], 0
    for key, node in found:
        keys.append(key)
        nodes.append(node)
        size += len(key)
        if size >= BATCH_KEYS:
            yield np.concatenate(keys), np.concatenate(nodes)
            keys, nodes, size = [], [], 0
    if size:
        yield np.concatenate(keys), np.concatenate(nodes)


def candidates(rows: DataFrame, n: int, percent: int, parts: int, bits: int = 64, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """kind, x, y: candidate pairs of nodes (kind 1), members of groups of three or more (kind 2: key, node)."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keyed() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for text in batch.column("text"):
                    grams = ngrams((text.as_py() or "").encode("utf-8", "surrogatepass"), n)
                    if len(grams):
                        keys = block_keys(grams, percent) >> np.uint64(16)
                        yield keys, np.full(len(keys), identity(grams, bits, clashes)[0], np.int64)

        for keys, nodes in _gathered(keyed()):
            key, node, least, size = _stars(keys, nodes)
            lead = node == least
            pairs = np.unique(np.stack([least[~lead], node[~lead]], axis=1), axis=0)
            members = _pack(key[~lead], node[~lead])
            # the lowest bit tells that the leader stands for others
            sent = ((key[lead] << np.uint64(1)) | (size[lead] > 1).astype(np.uint64)) & np.uint64((1 << 48) - 1)
            where, blobs = _dealt(key[lead], _pack(sent, node[lead]), parts)
            where, blobs = [*where, int(key[0] % np.uint64(parts))], [*blobs, None]
            nothing = [None] * (len(blobs) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blobs, pa.binary()), pa.array([*nothing, pairs.tobytes()], pa.binary()), pa.array([*nothing, members.tobytes()], pa.binary())], ["part", "entries", "pairs", "members"])

    def met(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        sent, nodes = (np.concatenate(x) for x in zip(*found, strict=True))
        several = np.unique((sent >> np.uint64(1))[(sent & np.uint64(1)) == 1])
        key, node, least, size = _stars(sent >> np.uint64(1), nodes)
        other = node != least
        pairs = np.unique(np.stack([least[other], node[other]], axis=1), axis=0)
        yield from _columns(1, pairs[:, 0], pairs[:, 1])
        many = (size > 2) | np.isin(key, several)
        yield from _columns(2, key[many], node[many])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = None, []
        for batch in batches:
            for row in one_by_one(batch):
                if row["pairs"] is not None:
                    pairs = np.frombuffer(row["pairs"], np.int64).reshape(-1, 2)
                    yield from _columns(1, pairs[:, 0], pairs[:, 1])
                    key, node = _unpack(row["members"])
                    yield from _columns(2, key & np.uint64((1 << 47) - 1), node)
                    continue
                if row["part"] != part:
                    yield from met(found)
                    part, found = row["part"], []
                found.append(_unpack(row["entries"]))
        yield from met(found)

    sent = rows.mapInArrow(lean(entries), "part int, entries binary, pairs binary, members binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(lean(join), "kind int, x long, y long")


def close(percent: int) -> Column:
    """Whether sets of sizes n and o_n with parity sketches sketch and o_sketch can link."""
    apart = F.bit_count(F.col("sketch")[0].bitwiseXOR(F.col("o_sketch")[0]))
    for w in range(1, SKETCH_WORDS):
        apart = apart + F.bit_count(F.col("sketch")[w].bitwiseXOR(F.col("o_sketch")[w]))
    return (100 * F.least("n", "o_n") >= percent * F.greatest("n", "o_n")) & (apart * (100 + percent) <= (F.col("n") + F.col("o_n")) * (100 - percent))


def near_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs a, b whose sketches allow a link."""
    right = pairs.select("a", "b").distinct().join(nodes.select(F.col("node").alias("b"), F.col("n").alias("o_n"), F.col("sketch").alias("o_sketch")), "b")
    return right.join(nodes.select(F.col("node").alias("a"), "n", "sketch"), "a").filter(close(percent)).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs a, b of nodes whose sets link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = None
        for batch in batches:
            keep = []
            for i, (b, packed) in enumerate(zip(batch.column("b").to_pylist(), batch.column("packed").to_pylist(), strict=True)):
                other = ngrams(unpack(packed), n)
                if b is None:  # the first of its group: the node that the others are compared with
                    grams = other
                    continue
                both = len(np.intersect1d(grams, other, assume_unique=True))
                if 100 * both >= percent * (len(grams) + len(other) - both):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    near = materialise(near_pairs(pairs, nodes, percent))
    # a node with very many pairs is dealt out, with a copy of its text for each share of them
    shares = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("shares"))
    firsts = shares.join(texts, shares["a"] == texts["node"]).select("a", F.explode(F.sequence(F.lit(1), "shares")).alias("share"), F.lit(None).cast("long").alias("b"), "packed")
    others = near.join(shares, "a").join(texts, F.col("b") == F.col("node")).select("a", (F.pmod(F.xxhash64("b"), "shares") + 1).cast("int").alias("share"), "b", "packed")
    met = firsts.unionByName(others).repartition("a", "share").sortWithinPartitions("a", "share", F.asc_nulls_first("b"))
    found = materialise(met.mapInArrow(lean(check), "a long, b long"))
    release(near)
    return found


def rare_pairs(mixed: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int, parts: int) -> DataFrame:
    """Pairs a < b of nodes of different labels that may link; mixed: node, label.

    Sets that link differ in at most d of the blocks of a finer sketch, so
    their d + 1 rarest block values have one in common; values that many near
    copies share are the last to be compared, and values of one label only make
    no pair. Values are counted in packed parts; only those of several labels
    travel back to their nodes.
    """

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keyed() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for node, label, packed in zip(batch.column("node").to_pylist(), batch.column("label").to_pylist(), batch.column("packed"), strict=True):
                    grams = ngrams(unpack(packed.as_py()), n)
                    keys = np.concatenate([np.zeros(0, np.uint64), *(f[2] for f in banded_keys(grams, percent, FINER))]) >> np.uint64(16)
                    yield keys, np.tile(np.array([[node, label]], np.int64), (len(keys), 1))

        for keys, named in _gathered(keyed()):
            packed = np.concatenate([_pack(keys, named[:, 0]), np.ascontiguousarray(named[:, 1:]).view(np.uint8)], axis=1)
            where, blobs = _dealt(keys, packed, parts)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blobs, pa.binary())], ["part", "entries"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_part(found: list[bytes]) -> Iterator[pa.RecordBatch]:
            raw = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 22)
            key, node = _unpack(np.ascontiguousarray(raw[:, :14]).tobytes())
            label = np.ascontiguousarray(raw[:, 14:]).view(np.int64).ravel()
            order = np.lexsort((label, key))
            key, node, label = key[order], node[order], label[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            several = label[start] != label[start + size - 1]
            times, kept = np.repeat(size, size), np.repeat(several, size)
            key, node, times = key[kept].astype(np.int64), node[kept], times[kept].astype(np.int64)
            for i in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (key, node, times)], ["value", "node", "times"])

        part, found = None, []
        for batch in batches:
            for row in one_by_one(batch):
                if row["part"] != part:
                    if found:
                        yield from of_part(found)
                    part, found = row["part"], []
                found.append(row["entries"])
        if found:
            yield from of_part(found)

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, differ, _ = bands(percent)
        for batch in batches:
            at, odd, total, most = [], [], [], []
            for i, packed in enumerate(batch.column("packed")):
                for band, d, keys in banded_keys(ngrams(unpack(packed.as_py()), n), percent, FINER):
                    at.append(i)
                    odd.append(band & 1)
                    total.append(len(np.unique(keys >> np.uint64(16))))
                    most.append(d + 1)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(at, pa.int64())), pa.array(odd, pa.int64()), pa.array(total, pa.int64()), pa.array(most, pa.int64())], ["node", "odd", "total", "most"])

    packed = materialise(mixed.join(texts, "node").select("node", "label", "packed"))
    sent = packed.mapInArrow(lean(finer), "part int, entries binary").repartition("part").sortWithinPartitions("part")
    values = materialise(sent.mapInArrow(lean(counted), "value long, node long, times long"))
    totals = packed.select("node", "packed").mapInArrow(lean(allowed), "node long, odd long, total long, most long")
    by_node = values.groupBy("node", F.col("value").bitwiseAND(F.lit(1)).alias("odd")).agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("values"))
    # the values of one label come first in the order, and pair with nothing
    left = F.greatest(F.lit(0), F.col("most") - (F.col("total") - F.size("values"))).cast("int")
    rarest = by_node.join(totals, ["node", "odd"]).select("node", F.explode(F.slice("values", F.lit(1), left)["value"]).alias("value"))
    kept = materialise(rarest.join(packed.select("node", "label"), "node").join(nodes.select("node", "n", "sketch"), "node"))
    other = kept.select("value", *(F.col(c).alias(f"o_{c}") for c in kept.columns if c != "value"))
    near = kept.join(other, (kept["value"] == other["value"]) & (F.col("node") < F.col("o_node")) & (F.col("label") != F.col("o_label")) & close(percent))
    found = materialise(near.select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct())
    release(packed, values, kept)
    return found


def link(docs: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text", node_bits: int = 64) -> DataFrame:
    """key, n_shingles and component_id of every row.

    Two texts link when their sets of n-grams (A-Z lower-cased, words split at
    ASCII white space) have a Jaccard similarity of ``percent`` % or more.
    component_id is the least key that links reach. Null and empty texts have
    no n-grams and link with nothing: their component_id is their own key.
    Repeated rows have equal sets and so share a component; null keys are never
    the least unless alone. Other columns are not read.

    Nodes are ``node_bits`` bits of a 128-bit digest of the set; where two
    different digests share them, the rest of the digest names the node.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(*row_keys(key, text), F.col(text).alias("text"))

    def sets_of(clashes: frozenset[int]) -> tuple[DataFrame, DataFrame]:
        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, ids, sketches = [], [], []
                for t in batch.column("text"):
                    grams = ngrams((t.as_py() or "").encode("utf-8", "surrogatepass"), n)
                    sizes.append(len(grams))
                    ids.append(identity(grams, node_bits, clashes) if len(grams) else (None, None))
                    sketches.append(parity(grams))
                node, check = (pa.array([i[k] for i in ids], pa.int64()) for k in (0, 1))
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * SKETCH_WORDS, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sketches])))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("row"), pa.array(sizes, pa.int64()), node, check, sketch], ["key", "row", "n_shingles", "node", "check", "sketch"])

        known = materialise(rows.mapInArrow(lean(sets), f"key {kind}, row binary, n_shingles long, node long, check long, sketch array<long>"))
        firsts = [F.first(c).alias(a) for c, a in (("key", "key"), ("row", "row"), ("n_shingles", "n"), ("sketch", "sketch"))]
        return known, materialise(known.filter(F.col("node").isNotNull()).groupBy("node").agg(*firsts, F.min("key").alias("least"), F.min("check").alias("low"), F.max("check").alias("high")))

    known, nodes = sets_of(frozenset())
    # nearly always none: of 64 bits, some ten billion different sets share one or two
    clashes = frozenset(r.node for r in nodes.filter(F.col("low") < F.col("high")).select("node").collect())
    if clashes:
        release(known, nodes)
        known, nodes = sets_of(clashes)
    grams = known.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * grams * (100 - percent) // (100 * PART_KEYS) * 2 + 1)
    met = materialise(candidates(rows.select("text"), n, percent, parts, node_bits, clashes))
    pairs = met.filter(F.col("kind") == 1).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    members = met.filter(F.col("kind") == 2).select(F.col("x").alias("group"), F.col("y").alias("node")).distinct()

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(members.select("node")).distinct()
    holders = nodes.join(wanted, "node").select("node", "key", "row")
    packed = packed_texts(rows)
    texts = materialise(packed.join(holders, [packed["key"].eqNullSafe(holders["key"]), packed["row"] == holders["row"]]).select("node", "packed").dropDuplicates(["node"]))

    tested = [materialise(pairs)]
    linked = [verified(pairs, nodes, texts, n, percent)]
    every = lambda tables: reduce(DataFrame.unionByName, tables)
    labels = components(linked[0])
    rounds = HUB_ROUNDS
    while True:
        named = members.join(labels, "node", "left").select("group", "node", F.coalesce("label", "node").alias("label"))
        sizes = named.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).filter(F.col("low") < F.col("high")).select("group", "size")
        mixed = materialise(named.join(sizes, "group"))
        last = rounds == 0
        if last:
            more = rare_pairs(mixed.select("node", "label").distinct(), nodes, texts, n, percent, parts)
        else:
            # the text that most copies were made from is in the most and largest groups
            central = mixed.groupBy("node").agg(F.sum("size").alias("weight"))
            hubs = mixed.join(central, "node").groupBy("group").agg(F.max(F.struct("weight", "node", "label")).alias("hub")).select("group", F.col("hub.node").alias("hub"), F.col("hub.label").alias("hub_label"))
            more = mixed.join(hubs, "group").filter(F.col("label") != F.col("hub_label")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
            more = materialise(more.join(every(tested), ["a", "b"], "left_anti"))
        tested.append(more)
        linked.append(verified(more, nodes, texts, n, percent))
        release(mixed)
        new = not linked[-1].isEmpty()
        if new:
            release(labels)
            labels = components(every(linked))
        if last:
            break
        rounds = rounds - 1 if new else 0  # with no new link, the hubs would be the same
    release(met, texts, *tested, *linked)

    # least key of each class by its nodes; both sides of a join are written, so that a class of very many can be split
    classes = materialise(nodes.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("class")))
    least = materialise(classes.groupBy("class").agg(F.min("least").alias("component")))
    named = materialise(classes.join(least, "class").select("node", "component"))
    found = known.select("key", "n_shingles", "node").join(named, "node", "left")
    found = materialise(found.select(F.col("key").alias(key), "n_shingles", F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component")).alias("component_id")))
    release(known, nodes, labels, classes, least, named)
    return found
