import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scholium.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " \n\t", "Hello World's it'll 12345 !!?", "ünïcödé été  x y\x1cz", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΣΑΣ İstanbul 你好世界 한국어 🙂👍🏽", "a" * 300]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_text(rnd, n):
    parts = ["a", "b", "the", "ing", "'s", "'re", "'", "-", "é", "é", " ", "\n", "1", "23", "<|endoftext|>", "<|end", "oftext|>", "漢字", "🙂", "%%%", "Z", "tion"]
    weights = [5, 3, 6, 6, 1, 1, 1, 1, 1, 1, rnd.choice([0, 0.02, 3]), 0.1, 1, 1, 0.3, 0.2, 0.2, 1, 1, 1, 1, 5]
    return "".join(rnd.choices(parts, weights, k=n))


@pytest.mark.parametrize("seed", range(40))
def test_tree_equals_whole(seed, library):
    rnd = random.Random(seed)
    text = random_text(rnd, rnd.choice([50, 400, 3000]))
    size = rnd.choice([7, 100, 333])
    codec = bpe.Codec.of(PATH)
    pieces = [text[i : i + size] for i in range(0, len(text), size)]
    ids = bpe.encode_tree(codec, [(p, codec.tokens(p)) for p in pieces]).ids.tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_operator_equals_library(spark, library):
    rnd = random.Random(1)
    texts = [*TEXTS, None, *(random_text(rnd, 900) for _ in range(12))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "a b", "x"), (14, texts[14], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(docs, PATH, long_chars=500, piece_chars=120).collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, len(ids), library.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r.doc_id, bpe.unpack_ids(r.ids), r.n_tokens, r.decoded) for r in got], key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_query_on_documents(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[k] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_words_are_cut_as_the_library_cuts_them():
    rnd = random.Random(2)
    codec = bpe.Codec.of(public_tokenizers.path("word_bpe_49k.json"))
    parts = [chr(i) for i in range(0x20, 0x500)] + ["'s", "'ll", "'RE", "n't", "<|", "<|endoftext|>", "İ", "Σ", "ς", "́", "ﬁ", "²", "½", "\t", "\n", "…", "’"] * 15
    for _ in range(1500):
        text = "".join(rnd.choices(parts, k=rnd.choice([1, 3, 8, 20])))
        ids = codec.tokenizer.encode(text, add_special_tokens=False).ids
        assert codec.encode_all([text]) == ([np.array(ids, "<u4").tobytes()], [codec.tokenizer.decode(ids, skip_special_tokens=False)])


def test_units_met_again_stay_known(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_UNITS", 60)
    codec = bpe.Codec(PATH)
    common = ["the", "of", "été", "x-ray?", "2"]
    codec.encode_all([" ".join(common)])
    first = {u: codec.ids[u] for u in ["the", "of", "été", "ray", "2"]}
    for k in range(20):
        rare = [f"q{c}z{d}" for c in "abcdefgh"[: 1 + k % 8] for d in "klmnop"[: 1 + k % 6]]
        codec.encode_all([" ".join([*common, *(w + "abcdefghijklmnopqrstuvwxyz"[k] for w in rare)])])
        assert len(codec.ids) <= 60
    assert all(codec.ids[u] is ids for u, ids in first.items())
