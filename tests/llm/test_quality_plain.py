"""The registered query against a plain fit and plain scores, row by row in Python."""

import math
import re
import zlib

import numpy as np

from scholium.llm import queries, quality

SF = "/root/testdata/sf0.001"


def plain_features(text):
    data = text.encode()
    words = [zlib.crc32(w) for w in data.lower().split()]
    bare = bytes(b for b in data if not (97 <= b <= 122 or b >= 128))
    skeletons = [zlib.crc32(w) for w in re.sub(rb"[A-Z]+", b"A", bare).split()]
    found = set(words) | {7919 * s + 1 for s in skeletons}
    found |= {31 * a + 17 * b + 5 for a, b in zip(words, words[1:], strict=False)}
    found |= {31 * a + 17 * b + 3 for a, b in zip(skeletons, skeletons[1:], strict=False)}
    if any(a == b for a, b in zip(words, words[1:], strict=False)):
        found.add(quality.DIMENSIONS - 1)
    if any(a == b == c for a, b, c in zip(words, words[1:], words[2:], strict=False)):
        found.add(quality.DIMENSIONS - 2)
    return sorted({f % quality.DIMENSIONS for f in found})


def plain_fit(rows, labels):
    seen = {0: {}, 1: {}}
    for row, label in zip(rows, labels, strict=True):
        for f in row:
            seen[label][f] = seen[label].get(f, 0) + 1
    total = {c: quality.DIMENSIONS + sum(seen[c].values()) for c in seen}
    ratio = {}
    for f in seen[0].keys() | seen[1].keys():
        good, bad = seen[1].get(f, 0), seen[0].get(f, 0)
        ratio[f] = math.log((good + 1) / total[1]) - math.log((bad + 1) / total[0]) if good + bad > quality.RARE else 0.0
    weights, bias, duals = dict.fromkeys(ratio, 0.0), 0.0, [0.0] * len(rows)
    order = np.random.default_rng(0)
    for _ in range(quality.EPOCHS):
        for i in order.permutation(len(rows)):
            sign = 1 if labels[i] else -1
            margin = sum(weights[f] * ratio[f] for f in rows[i]) + bias
            norm = sum(ratio[f] ** 2 for f in rows[i]) + 1
            dual = min(max(duals[i] - (sign * margin - 1) / norm, 0.0), quality.COST)
            for f in rows[i]:
                weights[f] += sign * (dual - duals[i]) * ratio[f]
            bias += sign * (dual - duals[i])
            duals[i] = dual
    return {f: weights[f] * ratio[f] for f in ratio}, bias


def test_scores_are_those_of_a_plain_fit(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in texts}
    learned = sorted(k for k in labels if zlib.crc32(str(k).encode()) % 3 != 1)
    assert 0 < len(learned) <= quality.MAX_TRAIN
    weights, bias = plain_fit([plain_features(texts[k]) for k in learned], [labels[k] for k in learned])
    got = {r.doc_id: r for r in queries.op9_quality(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        want = 1 / (1 + math.exp(-2 * (sum(weights.get(f, 0.0) for f in plain_features(text)) + bias)))
        assert abs(got[k].score - want) < 1e-3
