import hashlib
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scholium.llm import quality
from scholium.llm.words import one_by_one
from tests.llm import test_decontam, test_jaccard

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = [k for k, r in rows.items() if model.score(r.text) >= 0.5]
    classes = test_jaccard.brute([(k, rows[k].text) for k in good], 5, 80)
    single = [k for k, _, c in classes if k == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _ in test_decontam.brute([(k, rows[k].text) for k in single], items)}
    kept = sorted(set(single) - leaked)
    assert 0 < len(kept) < len(single) < len(good) < len(rows)

    for (_, stage), want in zip(corpus_pipeline.STAGES, (good, single, kept, kept), strict=False):
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert sorted(r.doc_id for r in docs.collect()) == sorted(want)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {r.doc_id: r for r in docs.collect()}
    assert any(clean[k].text != rows[k].text for k in kept)
    assert all(r.n_chars == len(r.text) for r in clean.values())

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == kept
    for r in got:
        ids = library.encode(clean[r.doc_id].text, add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_columns_that_clash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"predicted": F.lit(0), "score": F.lit("x"), "spans": F.lit(1), "component_id": F.lit(2), "start": F.lit(3)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert kept.count() > 0


def test_repeated_and_null_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "x", None, None, None), (None, None, None, None, None), (2, None, None, None, None), (3, "A b c d e f", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == [1, 2, None, None]
    kept = corpus_pipeline.redact_personal_data(spark, corpus_pipeline.drop_contaminated(spark, docs, SF), SF)
    assert kept.count() == 6
    assert corpus_pipeline.encode_tokens(spark, kept, SF).count() == 6
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_tasks_give_their_memory_back():
    code = """
from pathlib import Path
from scholium.llm.words import lean

held = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6
last = []

def work(batches):
    many = [b"x" * (2000 + k % 7) for k in range(100_000)]
    last.extend(many[::1000] + many[-1:])  # lie between and behind them, as what a worker keeps does
    yield held()

before = held()
most = max(lean(work)(iter([])))
assert most > before + 150, (before, most)
assert held() < before + 60, (before, most, held())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2])


def test_rows_of_a_batch_are_made_one_at_a_time():
    batch = pa.RecordBatch.from_pydict({"part": [1, 1, 2], "entries": [b"x" * 5_000_000, None, b"y" * 5_000_000]})
    tracemalloc.start()
    sizes = [len(r["entries"] or b"") for r in one_by_one(batch)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [5_000_000, 0, 5_000_000] and most < 8_000_000
