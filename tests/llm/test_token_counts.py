import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scholium.llm import queries, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", "\n", "one line", "a\nb\n\nc\n", "été\n漢字 🙂👍🏽\nx  \n  y", "no break " * 30, "tail\n", "\n\n\n\n a\n\n\nb", "x" * 5000]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_against_the_library(spark, rule):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)] + [(1, "\n", "k"), (None, None, "k")], "doc_id long, text string, key string")
    rows = token_counts.count_sections(docs, RANKS, public_tokenizers.PATTERN, rule).collect()
    for i, text in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.section)
        spans = library.encode(text, add_special_tokens=False).offsets
        lines = text.splitlines(keepends=True) or [""]
        starts = [sum(map(len, lines[:k])) for k in range(len(lines))]
        want = [0.0] * len(lines)
        for s, e in spans:
            parts = [max(0, min(e, a + len(x)) - max(s, a)) for a, x in zip(starts, lines, strict=True)]
            if rule == "shares":
                want = [w + p / sum(parts) for w, p in zip(want, parts, strict=True)]
            else:
                want[parts.index(max(parts)) if rule == "most" else next(k for k, p in enumerate(parts) if p)] += 1
        if i == 1:
            own = own[:1]
        assert [r.n_tokens for r in own] == pytest.approx(want)
        assert all(r.doc_tokens == len(spans) for r in own)
        assert "".join(text[r.start : r.stop] for r in own) == text
    assert [(r.section, r.n_tokens) for r in rows if r.doc_id is None] == [(0, 0)]
    assert token_counts.count_sections(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_query_on_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    made, _ = token_counts.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows, lines = {}, {}
    for r in queries.op5_token_counts(spark, "/root/testdata/sf0.001").collect():
        rows[r.doc_id] = rows.get(r.doc_id, 0) + r.n_tokens
        lines[r.doc_id] = lines.get(r.doc_id, 0) + 1
    assert rows == {k: len(made.encode_ordinary(t)) for k, t in texts.items()}
    assert all(lines[k] == max(1, len(t.split("\n")) - t.endswith("\n")) for k, t in texts.items())
