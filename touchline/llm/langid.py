"""Operator 7: language identification by a string kernel.

The kernel counts the byte n-grams (blended spectrum, presence) that two texts share, over the root of their
numbers of n-grams. Nyström landmarks from a bounded labelled sample turn it into features; one-versus-rest kernel ridge
regression is trained on them. Scoring multiplies a batch's presence matrix by the landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.common import has_letter, lowered, slices, texts_of

#: Rows of each language in the training sample and of all together (but one of each language), landmarks likewise, and the ridge.
PER_LANG, SAMPLE, LANDMARKS, ALL_LANDMARKS, RIDGE = 600, 4000, 24, 400, 0.05
SPACE = 1 << 16  # one region of presence bits for pairs of bytes, one for hashed triples
ROWS = 128


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which n-grams each text holds: rows by 2 * SPACE of bool."""
    data = lowered(data).astype(np.uint32)
    out = np.zeros((len(offsets) - 1, 2 * SPACE), bool)
    pair = data[:-1] << 8 | data[1:]
    triple = (((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)) >> np.uint32(16)) + np.uint32(SPACE)
    for k, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
        out[k, pair[a : max(a, b - 1)]] = True
        out[k, triple[a : max(a, b - 2)]] = True
    return out


@dataclass(frozen=True)
class Model:
    """Grams that landmarks hold, landmarks' presence over them and sizes, and the weights of kernel values."""

    langs: list[str]
    grams: np.ndarray
    landmarks: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        size = np.maximum(np.count_nonzero(bits, axis=1), 1)
        return (bits[:, self.grams].astype(np.float32) @ self.landmarks) / (np.sqrt(size)[:, None] * self.roots)

    def scores(self, bits: np.ndarray) -> np.ndarray:
        return self.kernel(bits) @ self.weights + self.bias


def unpacked(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, axis=1).astype(bool)


def fit(packed: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The model of a sample (packed presence bits) in a given order; its first rows of each language are the landmarks, ALL_LANDMARKS
    at most. Bits are unpacked ROWS at a time."""
    names = sorted(set(langs))
    if not names:
        return None
    label = np.searchsorted(names, langs)
    each = max(1, min(landmarks, ALL_LANDMARKS // len(names)))
    chosen = np.sort(np.concatenate([np.flatnonzero(label == k)[:each] for k in range(len(names))]))[:ALL_LANDMARKS]
    own = unpacked(packed[chosen])
    grams = np.flatnonzero(own.any(axis=0))
    size = np.maximum(np.count_nonzero(own, axis=1), 1)
    rough = Model(names, grams, own[:, grams].astype(np.float32).T.copy(), np.sqrt(size).astype(np.float32), np.zeros(0), np.zeros(0))
    k = np.concatenate([rough.kernel(unpacked(packed[a : a + ROWS])) for a in range(0, len(packed), ROWS)]).astype(np.float64)
    value, vector = np.linalg.eigh(k[chosen])
    keep = value > 1e-6 * max(value.max(), 1e-12)
    to = vector[:, keep] / np.sqrt(value[keep])
    x = k @ to
    mean = x.mean(axis=0)
    y = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    rows = 1 / np.bincount(label)[label] * len(label) / len(names)  # languages count alike
    centre = np.average(y, axis=0, weights=rows)
    x = x - mean
    w = np.linalg.solve((x * rows[:, None]).T @ x + ridge * np.eye(x.shape[1]), (x * rows[:, None]).T @ (y - centre))
    return Model(names, grams, rough.landmarks, rough.roots, (to @ w).astype(np.float32), (centre - mean @ w).astype(np.float32))


def train(docs: DataFrame, per_lang: int = PER_LANG, sample: int = SAMPLE) -> Model | None:
    """Fits on ``per_lang`` rows of each language, or as many fewer as keep all languages within ``sample``, one at least: those
    of the smallest hash of doc_id. Every language is learned. A doc_id counts once in a language, with the text of the smallest hash if
    it has several; rows without one are one id. Presence bits come to the driver."""
    labelled = docs.where("lang is not null and text is not null")
    langs = labelled.agg(F.countDistinct("lang")).first()[0]
    if not langs:
        return None
    place = F.xxhash64(F.col("doc_id").cast("string"))
    slim = labelled.select(F.col("doc_id").cast("long").alias("id"), "lang", place.alias("place")).distinct().withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy("place", "id")))
    chosen = slim.where(F.col("rn") <= min(per_lang, max(1, sample // langs))).select("id", F.col("lang").alias("own"), "place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in parts(batches):
            bits = np.packbits(presence(data, offsets), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("lang"), pa.array([b.tobytes() for b in bits], pa.binary())], ["place", "lang", "bits"])

    # ``chosen`` holds max(sample, languages) rows of two numbers and a name at most
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("own"))
    picked = labelled.select("doc_id", "text", "lang").join(F.broadcast(chosen), same)
    picked = picked.groupBy(F.col("id").alias("doc_id"), "lang", "place").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    made = texts_of(picked, "lang", "place").mapInArrow(work, "place long, lang string, bits binary")
    rows = sorted(made.collect(), key=lambda r: (r.place, r.lang, bytes(r.bits)))
    return fit(np.frombuffer(b"".join(bytes(r.bits) for r in rows), np.uint8).reshape(len(rows), -1), [r.lang for r in rows])


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of no more than ROWS rows."""
    for batch, data, offsets in slices(batches):
        for a in range(0, batch.num_rows, ROWS):
            own = offsets[a : a + ROWS + 1]
            yield batch.slice(a, ROWS), data[own[0] : own[-1]], own - own[0]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every row; ``und`` and 0 for null, for texts without a letter, and without a model."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch, data, offsets in parts(batches):
            names, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if model is not None:
                made = model.scores(presence(data, offsets))
                best = made.argmax(axis=1)
                sure = np.clip((made[np.arange(len(best)), best].astype(float) + 1) / 2, 0, 1)
                for k, text in enumerate(batch.column("text").to_pylist()):
                    if has_letter(text):
                        names[k], score[k] = model.langs[best[k]], sure[k]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return texts_of(docs).mapInArrow(work, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, held_out_of: int = 3, held_out: int = 1, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Rows with crc32(doc_id as text) mod ``held_out_of`` equal ``held_out`` teach nothing.

    Null, empty and letterless texts are ``und`` with score 0; texts of any length count whole; rows that repeat get equal
    results; an empty table gives an empty result. Columns other than doc_id, text and lang are ignored.
    """
    is_held = F.crc32(F.col("doc_id").cast("string")) % held_out_of == held_out
    model = train(docs.where(~is_held), per_lang)
    return predict(docs, model).select("doc_id", is_held.alias("held_out"), "lang_pred", "score")
