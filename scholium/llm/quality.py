"""Quality classifier: a linear hinge-loss model on scaled n-gram indicators.

The n-grams of a text are its lower-cased words alone and in pairs, the words' skeletons (what is
left without lower-case letters: punctuation, digits, one A for each run of
capitals) alone and in pairs, and the immediate repetition of a word. Each is
hashed to one of ``DIMENSIONS`` indicators. An indicator is scaled by the log
ratio of its smoothed frequency in the two classes (naive Bayes), and a linear
support vector machine is fitted on the scaled indicators by dual coordinate
descent.

The model is fitted on at most ``MAX_TRAIN`` labelled rows, those with the
smallest hash of the id; this bound is a parameter. Scoring reads every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.words import lean

DIMENSIONS = 1 << 18
MAX_TRAIN = 8_000
COST = 0.1
EPOCHS = 8
#: Indicators seen in no more rows than this carry no evidence.
RARE = 1
LOWER = bytes(range(97, 123)) + bytes(range(128, 256))
CAPITALS = re.compile(rb"[A-Z]+")


def features(text: str) -> np.ndarray:
    """The distinct indicators of one text."""
    data = text.encode("utf-8", "replace")
    words = np.array(list(map(zlib.crc32, data.lower().split())), np.int64)
    skeletons = np.array(list(map(zlib.crc32, CAPITALS.sub(b"A", data.translate(None, LOWER)).split())), np.int64)
    twice = words[1:] == words[:-1]
    repeats = np.array([DIMENSIONS - 1] * bool(twice.any()) + [DIMENSIONS - 2] * bool((twice[1:] & twice[:-1]).any()), np.int64)
    found = [words, words[:-1] * 31 + words[1:] * 17 + 5, skeletons * 7919 + 1, skeletons[:-1] * 31 + skeletons[1:] * 17 + 3, repeats]
    return np.unique(np.concatenate(found) % DIMENSIONS).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        margin = float(self.weights[features(text)].sum()) + self.bias
        return 1 / (1 + np.exp(-np.clip(2 * margin, -500, 500)))


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> Model:
    """Fit on indicator lists and 0/1 labels; with one class only, a constant."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(DIMENSIONS, np.float32), float(2 * labels[0] - 1) if len(labels) else 0.0)
    seen = {c: 1.0 + np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == c]), minlength=DIMENSIONS) for c in (0, 1)}
    ratio = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    ratio[seen[0] + seen[1] <= RARE + 2] = 0
    scaled = [ratio[r] for r in rows]
    norms = [float(x @ x) + 1 for x in scaled]
    weights, bias, duals = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            sign = 1.0 if labels[i] else -1.0
            slope = sign * (float(weights[rows[i]] @ scaled[i]) + bias) - 1
            dual = min(max(duals[i] - slope / norms[i], 0.0), cost)
            step = (dual - duals[i]) * sign
            if step:
                weights[rows[i]] += step * scaled[i]
                bias += step
                duals[i] = dual
    return Model((weights * ratio).astype(np.float32), bias)


def held_out(key: str) -> Column:
    """Rows whose labels are never learned: crc32 of the id's text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", max_train: int = MAX_TRAIN) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    sample = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key))
        .groupBy(F.col(key).alias("key"))
        .agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(max_train)
    )
    # max_train bounds this side
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), "key").select("key", "label", "text")

    def indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(found, pa.binary())], ["key", "label", "indicators"])

    kind = docs.schema[key].dataType.simpleString()
    # repeated ids could go past the bound: of each id, one text is learned
    single = rows.groupBy("key", "label").agg(F.min("text").alias("text"))
    found = sorted(single.mapInArrow(lean(indicators), f"key {kind}, label int, indicators binary").collect())
    return fit_rows([np.frombuffer(r.indicators, np.int32) for r in found], np.array([r.label for r in found], np.int64))


def score(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns ``carry`` of each row with score (0 to 1) and predicted, under the given names.

    A null text counts as empty and is scored by the bias alone; repeated rows
    each give a row; no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = [f"c{i}" for i in range(len(carry))]
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(inner, carry, strict=True))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(t or "") for t in batch.column("scored_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in inner), pa.array(found, pa.float64())], [*inner, "score"])

    rows = docs.select(*(F.col(c).alias(n) for n, c in zip(inner, carry, strict=True)), F.col(text).alias("scored_text"))
    scored = rows.mapInArrow(lean(scores), f"{kinds}, score double")
    return scored.select(*(F.col(n).alias(c) for n, c in zip(inner, carry, strict=True)), F.col("score").alias(names[0]), (F.col("score") >= 0.5).cast("int").alias(names[1]))
