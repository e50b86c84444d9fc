"""BPE encoding and decoding of whole texts, with tree concatenation.

Texts of up to ``long_chars`` characters are encoded in one go. Where the
tokenizer normalises by NFC, white space and lower case and cuts words by a
pattern, a text of common characters is cut by the same pattern here and its
words are looked up; a word not known yet goes to the tokenizer's model as it is,
since nothing is left to normalise or cut. Each task keeps the words it has met;
when they are too many, those met once only go. Any other text is cut at white
space, which never joins tokens in the tokenizers used here.

Long texts are cut into pieces at fixed places, dealt to tasks and encoded in
parallel. The pieces of a text are then joined pairwise as a tree: around each
join a window is encoded again and grown until it holds one token in common
with the left encoding and one with the right one. Adjacent tokens of a BPE
encoding stay valid neighbours in any longer word, so two encodings that share
a token (same id, same place) can be spliced there and the result is the
encoding of the joined text, exactly. If no common token turns up, the window
has grown to the whole text and its encoding is the result.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.words import lean

LONG_CHARS = 65_536
PIECE_CHARS = 32_768
CACHED_UNITS = 120_000
#: Texts that a task cuts and encodes at a time.
BATCH_TEXTS = 250
#: Longer than every added token of the vocabulary, in characters.
MARGIN = 32
#: Separators for str.split() that the tokenizers' own \s does not know.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Characters that lower-casing and the classes of every regular expression engine agree on: ASCII but for controls, Latin, Greek, Cyrillic, dashes and quotes.
UNCOMMON = re.compile("[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f\u0388-\u03a1\u03a3\u03a4-\u03ce\u0400-\u0482\u048a-\u04ff\u2010-\u201f\u2026]|\u03a3|<\\|")

#: The characters that byte-level models take for bytes.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: b if b in _SHOWN else 0x100 + sum(c not in _SHOWN for c in range(b)) for b in range(0x100)}

_codecs: dict[str, Codec] = {}


def word_pattern(path: str) -> regex.Pattern | None:
    """The pattern that cuts normalised text into words, if words are all that the tokenizer looks at."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    normal, cut = made.get("normalizer") or {}, (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [])]
    if steps != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] or made.get("post_processor") or any(t["normalized"] or not t["content"].startswith("<|") for t in made["added_tokens"]):
        return None
    if [c["type"] for c in cut] != ["Split", "ByteLevel"] or "Regex" not in cut[0]["pattern"] or (cut[0]["behavior"], cut[0]["invert"]) != ("Removed", True) or cut[1]["add_prefix_space"] or cut[1]["use_regex"]:
        return None
    return regex.compile(cut[0]["pattern"]["Regex"])


class Codec:
    """A tokenizer file with a bounded cache of encoded units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain_join = self.tokenizer.decoder is None
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.names = np.array([self.tokenizer.id_to_token(i) for i in range(size)], object)
        self.ids: dict[str, bytes] = {}
        self.met_again: set[str] = set()
        self.words = word_pattern(path)

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in _codecs:
            _codecs[path] = cls(path)
        return _codecs[path]

    def learn(self, words: set[str], parts: set[str]) -> None:
        """Know the ids of words of the pattern, and of other parts of texts."""
        units = words | parts
        new = units - self.ids.keys()
        self.met_again |= units - new
        if len(new) + len(self.ids) > CACHED_UNITS:
            if len(new) + len(self.met_again) > CACHED_UNITS:
                self.forget()
            self.ids = {u: self.ids[u] for u in self.met_again}
            self.met_again = set()
            new = units - self.ids.keys()
        model = self.tokenizer.model
        for word in new & words:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARS)
            self.ids[word] = array("I", [t.id for t in model.tokenize(shown)]).tobytes()
        others = list(new - words)
        for start in range(0, len(others), 4_000):
            some = others[start : start + 4_000]
            for unit, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.ids[unit] = array("I", found.ids).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        if self.plain_join:
            return " ".join(self.names[ids].tolist())
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def cut(self, text: str) -> tuple[list[str] | None, bool]:
        """Parts of a text that are encoded each by itself (None if there is no safe cut), and whether they are words of the pattern."""
        if self.words and not UNCOMMON.search(text) and unicodedata.is_normalized("NFC", text):
            return self.words.findall(text.lower()), True
        return (None if ODD_SPACE.search(text) else text.split()), False

    def forget(self) -> None:
        """Free the units, so that a worker that goes on to other work is small."""
        self.ids, self.met_again = {}, set()

    def encode_all(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Little-endian unsigned 32-bit ids, and decoded text, of each text."""
        split = [self.cut(t) for t in texts]
        self.learn(*({unit for units, whole in split if units and whole is kind for unit in units} for kind in (True, False)))
        ids, decoded = [], []
        for text, (units, _) in zip(texts, split, strict=True):
            if units is None:
                ids.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                ids.append(b"".join(map(self.ids.__getitem__, units)))
            decoded.append(self.decode(np.frombuffer(ids[-1], "<u4")))
        return ids, decoded

    def tokens(self, text: str) -> Tokens:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(found.offsets, np.int64).reshape(-1, 2)
        return Tokens(np.array(found.ids, np.int64), spans[:, 0], spans[:, 1])


class Tokens:
    """Ids with start and end offsets in characters."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.ids, self.starts, self.ends = ids, starts, ends

    def part(self, first: int, last: int, shift: int = 0) -> Tokens:
        return Tokens(self.ids[first:last], self.starts[first:last] + shift, self.ends[first:last] + shift)

    @staticmethod
    def chain(parts: list[Tokens]) -> Tokens:
        return Tokens(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("ids", "starts", "ends")))


def _clean_cut(text: str, at: int) -> bool:
    """Whether normalising cannot move or merge anything across ``at``."""
    if not 0 < at < len(text):
        return True
    pair = text[at - 1 : at + 1]
    return not unicodedata.combining(pair[1]) and unicodedata.normalize("NFC", pair) == pair


def _common(text: str, side: Tokens, window: Tokens, low: int, high: int, last: bool) -> tuple[int, int] | None:
    """Indexes, in ``side`` and ``window``, of a token that both have between the offsets; the last or the first such."""
    there = {(s, e, i): k for k, (s, e, i) in enumerate(zip(side.starts.tolist(), side.ends.tolist(), side.ids.tolist(), strict=True)) if s >= low and e <= high}
    own = list(enumerate(zip(window.starts.tolist(), window.ends.tolist(), window.ids.tolist(), strict=True)))
    for k, token in reversed(own) if last else own:
        # the pieces of one character's bytes share its offsets; only a token alone there marks a place
        alone = (k == 0 or window.ends[k - 1] <= token[0]) and (k + 1 == len(own) or window.starts[k + 1] >= token[1])
        if token in there and alone and token[0] < token[1] and _clean_cut(text, token[0]) and _clean_cut(text, token[1]):
            return there[token], k
    return None


def join_encodings(codec: Codec, left_text: str, left: Tokens, right_text: str, right: Tokens, window: int = 64) -> Tokens:
    """The encoding of ``left_text + right_text`` from those of its halves."""
    text, cut = left_text + right_text, len(left_text)
    if not left_text or not right_text:
        return Tokens.chain([left, right.part(0, len(right.ids), cut)])
    right = right.part(0, len(right.ids), cut)
    while window < len(text):
        at = np.searchsorted(left.starts, max(0, cut - window), "right") - 1
        begin = int(left.starts[at]) if at >= 0 else 0
        at = np.searchsorted(right.ends, min(len(text), cut + window), "left")
        end = int(right.ends[at]) if at < len(right.ends) else len(text)
        again = codec.tokens(text[begin:end])
        again = again.part(0, len(again.ids), begin)
        before = (0, -1) if begin == 0 else _common(text, left, again, begin, cut - MARGIN, last=True)
        after = (0, len(again.ids)) if end == len(text) else _common(text, right, again, cut + MARGIN, end - MARGIN, last=False)
        if before and after and before[1] < after[1]:
            head = [] if begin == 0 else [left.part(0, before[0] + 1)]
            tail = [] if end == len(text) else [right.part(after[0], len(right.ids))]
            return Tokens.chain([*head, again.part(before[1] + 1, after[1]), *tail])
        window *= 2
    return codec.tokens(text)


def encode_tree(codec: Codec, pieces: list[tuple[str, Tokens]]) -> Tokens:
    """Join the encodings of consecutive pieces level by level."""
    while len(pieces) > 1:
        pairs = [(pieces[i], pieces[i + 1]) for i in range(0, len(pieces) - 1, 2)]
        joined = [(a[0] + b[0], join_encodings(codec, a[0], a[1], b[0], b[1])) for a, b in pairs]
        pieces = joined + pieces[2 * len(pairs) :]
    return pieces[0][1]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", long_chars: int = LONG_CHARS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Encode and decode ``text`` of every row.

    Returns key, ids (binary: little-endian unsigned 32-bit ids), n_tokens and
    decoded. A null text counts as empty: no ids, empty decoded text. Repeated
    rows each give a row; a null key stays null; other columns are not read.
    ``tokenizer`` is the path of a tokenizers file, the same on all executors.
    """
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = f"key {key_type}, ids binary, n_tokens long, decoded string"
    fields = pa.schema([("ids", pa.binary()), ("n_tokens", pa.int64()), ("decoded", pa.large_string())])

    def result(keys: pa.Array, ids: list[bytes], decoded: list[str]) -> pa.RecordBatch:
        columns = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays([keys, *columns], ["key", *fields.names])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tokenizer)
        for batch in batches:
            for start in range(0, len(batch), BATCH_TEXTS):
                some = batch.slice(start, BATCH_TEXTS)
                yield result(some.column("key"), *codec.encode_all(some.column("text").to_pylist()))
        codec.forget()

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tokenizer)
        for batch in batches:
            for start in range(0, len(batch), 50):
                some = batch.slice(start, 50)
                found = [codec.tokens(t) for t in some.column("piece").to_pylist()]
                packed = {k: pa.array([getattr(t, k).astype("<i4").tobytes() for t in found], pa.binary()) for k in ("ids", "starts", "ends")}
                yield pa.RecordBatch.from_arrays([*some.columns, *packed.values()], [*some.schema.names, *packed])

    def join(group: pa.Table) -> pa.Table:
        codec = Codec.of(tokenizer)
        rows = sorted(group.select(["no", "piece", "ids", "starts", "ends"]).to_pylist(), key=lambda r: r["no"])
        pieces = [(r["piece"], Tokens(*(np.frombuffer(r[k], "<i4").astype(np.int64) for k in ("ids", "starts", "ends")))) for r in rows]
        ids = encode_tree(codec, pieces).ids
        copies = group.column("copies")[0].as_py()
        keys = pa.array([group.column("key")[0].as_py()] * copies, group.schema.field("key").type)
        return pa.Table.from_batches([result(keys, [ids.astype("<u4").tobytes()] * copies, [codec.decode(ids)] * copies)])

    short = rows.filter(F.length("text") <= long_chars).mapInArrow(lean(whole), out)
    size = F.lit(piece_chars)
    pieces = (
        rows.filter(F.length("text") > long_chars)
        .groupBy("key", "text")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("key", "copies", F.xxhash64("key", "text").alias("row"), F.transform(F.sequence(F.lit(0), ((F.length("text") - 1) / size).cast("int")), lambda i: F.substring(F.col("text"), i * size + 1, size)).alias("pieces"))
        .select("key", "copies", "row", F.posexplode("pieces").alias("no", "piece"))
        .repartition("row", "no")
    )
    encoded = pieces.mapInArrow(lean(halves), f"key {key_type}, copies long, row long, no int, piece string, ids binary, starts binary, ends binary")
    # a null key is a group of its own here
    long = encoded.groupBy("key", "row").applyInArrow(join, out)
    return short.unionByName(long).withColumnRenamed("key", key)


def unpack_ids(ids: bytes) -> list[int]:
    """The ids of one row as a list."""
    return np.frombuffer(ids, "<u4").tolist()
