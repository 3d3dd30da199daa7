"""Operator 7: quality classifier by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of byte-class trigrams (hashed) and of a few measures of
repetition, case and marks. A bounded sample of labelled documents, ``SAMPLE`` of
each label at most, gives the weights and, by singular value decomposition, the
latent axes. The sample's vectors (``2 * SAMPLE`` rows of ``AXES`` floats, whatever
the corpus) are broadcast; every document's exact cosines with all of them come from
blocked matrix products, and the labels of the most similar vote with their similarity.

Labels are learnt only from rows whose crc32(doc_id) mod 5 is not 0. doc_id, lang,
source and labels are no inputs of a score.

Defined cases: null text is empty, and an empty text has a vector like any other;
labels null or without a document are left out; if a doc_id has several labels, their
mean is learnt; repeated rows score alike; extra columns pass through ``classify``, but one
named score or predicted gives way to the output; without any labels the score is the neutral 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import blocks, texts

#: Labelled documents of each label that the model keeps at most.
SAMPLE = 1500
AXES = 40
BUCKETS = 2048
NEIGHBOURS = 15
#: Power of the similarity with which a neighbour votes.
SHARPNESS = 8
THRESHOLD = 0.3
#: Documents of one matrix product.
ROWS = 1024
MEASURES = 10
#: Weight of the measures against the trigrams.
MEASURE_WEIGHT = 1.5

_CLASS = np.zeros(256, dtype=np.uint64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _b >= 128 else 5 if _c == " " else 6 + _b


def vectors(block: list[str]) -> np.ndarray:
    """Hashed trigram frequencies (square roots) and measures of each text."""
    out = np.zeros((len(block), BUCKETS + MEASURES), dtype=np.float32)
    for row, text in zip(out, block, strict=True):
        data = text.encode("utf-8", "surrogatepass")
        if len(data) > 2:
            kinds = _CLASS[np.frombuffer(data, dtype=np.uint8)]
            hashed = (kinds[:-2] * np.uint64(40503) + kinds[1:-1] * np.uint64(2057) + kinds[2:] * np.uint64(131)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(53)
            row[:BUCKETS] = np.sqrt(np.bincount(hashed.astype(np.int64), minlength=BUCKETS) / len(hashed))
        words = data.split()
        n = max(1, len(words))
        lines = [x for x in data.split(b"\n") if x.strip()]
        row[BUCKETS:] = (
            min(1.0, np.log1p(len(words)) / 12),
            1 - len(set(words)) / n,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
            1 - len(set(lines)) / max(1, len(lines)),
            sum(x.isupper() for x in words) / n,
            min(1.0, sum(data.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")) / n),
            min(1.0, data.count(b"!") / n),
            min(1.0, len(data) / n / 20),
            min(1.0, sum(data.count(c) for c in (b".", b",")) / n),
            1 - len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        )
    out[:, BUCKETS:] *= MEASURE_WEIGHT
    return out


@dataclass
class Model:
    """What is broadcast: feature weights, axes, and the sample's latent vectors and labels."""

    weights: np.ndarray
    axes: np.ndarray
    known: np.ndarray
    labels: np.ndarray

    def latent(self, rows: np.ndarray) -> np.ndarray:
        out = (rows * self.weights) @ self.axes
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def scores(self, block: list[str]) -> np.ndarray:
        if not len(self.known):
            return np.full(len(block), 0.5)
        out = []
        for start in range(0, len(block), ROWS):
            near = self.latent(vectors(block[start : start + ROWS])) @ self.known.T
            k = min(NEIGHBOURS, near.shape[1])
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(near, best, axis=1), 1e-6).astype(np.float64) ** SHARPNESS
            out.append((votes * self.labels[best]).sum(axis=1) / votes.sum(axis=1))
        return np.clip(np.concatenate(out), 0.0, 1.0) if out else np.zeros(0)


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """The model of a sample's feature vectors and labels."""
    width = BUCKETS + MEASURES
    if not len(rows):
        return Model(np.ones(width, dtype=np.float32), np.zeros((width, AXES), dtype=np.float32), np.zeros((0, AXES), dtype=np.float32), labels)
    weights = np.log((len(rows) + 1) / ((rows > 0).sum(axis=0) + 0.5)).astype(np.float32).clip(0.3, 4.0)
    weights[BUCKETS:] = 1.0
    weighted = rows * weights
    _, directions = np.linalg.eigh(weighted.T @ weighted)
    axes = np.ascontiguousarray(directions[:, ::-1][:, :AXES]).astype(np.float32)
    model = Model(weights, axes, np.zeros((0, AXES), dtype=np.float32), labels)
    model.known = model.latent(rows).astype(np.float32)
    return model


def held_out(doc_id: str) -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from ``sample`` documents of each label at most: those whose doc_id has the smallest hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.avg("quality").alias("label"))
    there = docs.where("doc_id is not null").select("doc_id").distinct()
    usable = known.join(there, "doc_id")
    picked = []
    for side in (F.col("label") >= 0.5, F.col("label") < 0.5):
        picked += usable.where(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()  # ids and labels, bounded by sample
    if not picked:
        return fit(np.zeros((0, 0)), np.zeros(0))
    label_of = {r["doc_id"]: r["label"] for r in picked}
    chosen = docs.sparkSession.createDataFrame([(int(k),) for k in label_of], "doc_id long")
    texts_ = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["doc_id"], "left_semi").select("doc_id", "text")
    found = {r["doc_id"]: np.frombuffer(r["v"], dtype=np.float32) for r in texts_.mapInArrow(_vector_rows, "doc_id long, v binary").groupBy("doc_id").agg(F.min("v").alias("v")).collect()}
    ids = sorted(found)
    return fit(np.stack([found[i] for i in ids]), np.array([label_of[i] for i in ids], dtype=np.float64))


def _vector_rows(batches):
    for block in blocks(batches, "text"):
        rows = [v.tobytes() for v in vectors(texts(block))]
        yield pa.RecordBatch.from_arrays([block.column(block.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "v"])


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, drop_text: bool = True) -> DataFrame:
    """``docs`` (without its text, if ``drop_text``) with score and predicted."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    own = ("score", "predicted")
    kept = [c for c in docs.columns if c not in own and not (drop_text and c == text)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])

    def run(batches):
        model = spread.value
        for block in blocks(batches, text):
            yield pa.RecordBatch.from_arrays([block.column(block.schema.get_field_index(c)) for c in kept] + [pa.array(model.scores(texts(block, text)))], names=schema.names)

    scored = docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = classify(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
