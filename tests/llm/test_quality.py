import zlib

import numpy as np

from scholium.llm import queries, quality


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op9_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    own = [got[r.doc_id].predicted == r.quality for r in labels if got[r.doc_id].held_out]
    assert np.mean(own) > 0.93


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", "a"), (2, "### %%% ###", "b"), (3, None, "c"), (None, "", "d"), (1, "good words here", "a"), (4, "good " * 50_000, "e")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, None), (None, 1)], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 6
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).collect() == []
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.predicted for r in quality.score(docs, nothing).collect()} == {1}
