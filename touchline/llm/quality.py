"""Operator 10: quality classifier on random-indexing word vectors.

Words get sparse ternary index vectors; a word's vector sums those of its neighbours over the whole corpus
(exact integers, so the result does not depend on the order of tasks). Documents pool their words' vectors, and a two-layer
network trained on a bounded labelled sample scores them; a temperature fitted on a part it was not trained on calibrates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import STEP_BYTES, mix, run_hashes, runs, slices, texts_of

#: Word buckets (by hash), vector length, neighbours to each side, and the most labelled rows that the network sees.
BUCKETS, DIM, REACH, SAMPLE = 1 << 15, 32, 2, 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.01, 1e-4
THRESHOLD = 0.7


def _kinds() -> np.ndarray:
    """A class for each byte: 0 white or control, 1 letters and non-ASCII, 2 digits, 3 other signs."""
    out = np.full(256, 3, np.uint8)
    out[:33], out[127], out[128:] = 0, 0, 1
    out[65:91] = out[97:123] = 1
    out[48:58] = 2
    return out


KIND = _kinds()


def bucket_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each word: a run of letters, of digits, or of signs, case kept."""
    kind = KIND[data]
    n = len(data)
    change = np.ones(n, bool)
    if n:
        change[1:] = kind[1:] != kind[:-1]
        change[offsets[:-1][offsets[:-1] < n]] = True
    at = np.flatnonzero(change)
    end = np.append(at[1:], n)
    word = kind[at] > 0
    at, end = at[word], end[word]
    return (run_hashes(data, at, end) % np.uint64(BUCKETS)).astype(np.int32), np.searchsorted(offsets, at, side="right") - 1


def index_vectors() -> np.ndarray:
    """Four entries of 1 or -1 for each bucket, by hash, and a zero row for no word."""
    out = np.zeros((BUCKETS + 1, DIM), np.int16)
    for k in range(4):
        h = mix(np.arange(BUCKETS, dtype=np.uint64) * np.uint64(4) + np.uint64(k + 1))
        out[np.arange(BUCKETS), (h % np.uint64(DIM)).astype(int)] += np.where(h >> np.uint64(63), 1, -1).astype(np.int16)
    return out


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vectors (BUCKETS by DIM, unit length or zero) from all of ``docs``. A task sends one row for each bucket at most;
    the sums that come to the driver are BUCKETS rows, however large the corpus."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total, seen = index_vectors(), np.zeros((BUCKETS, DIM), np.int64), np.zeros(BUCKETS, np.int64)
        for _, data, offsets in slices(batches, limit=STEP_BYTES // 2):
            word, row = bucket_words(data, offsets)
            if not len(word):
                continue
            around = np.zeros((len(word), DIM), np.int16)
            for k in range(1, REACH + 1):
                if len(word) > k:
                    same = row[k:] == row[:-k]
                    around[:-k] += index[np.where(same, word[k:], BUCKETS)]
                    around[k:] += index[np.where(same, word[:-k], BUCKETS)]
            order = np.argsort(word, kind="stable")
            ordered = word[order]
            first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            total[ordered[first]] += np.add.reduceat(around[order], first, axis=0, dtype=np.int64)
            seen += np.bincount(word, minlength=BUCKETS)
        some = np.flatnonzero(seen)
        for k in range(0, len(some), 2048):
            at = some[k : k + 2048]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.FixedSizeListArray.from_arrays(pa.array(total[at].ravel()), DIM).cast(pa.list_(pa.int64()))], ["bucket", "sums"])

    made = texts_of(docs).mapInArrow(work, "bucket long, sums array<long>")
    summed = made.groupBy("bucket").agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(DIM)])
    out, table = np.zeros((BUCKETS, DIM)), summed.toArrow()
    out[table.column("bucket").to_numpy()] = np.array([table.column(f"s{k}").to_numpy() for k in range(DIM)]).T.reshape(-1, DIM)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(length, 1)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's word vectors and two measures of its length; zeros for no words."""
    word, row = bucket_words(data, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, 2 * DIM + 2), np.float32)
    rows, first = np.unique(row, return_index=True)
    if len(rows):
        own = vectors[word]
        count = np.diff(np.append(first, len(row)))[:, None]
        mean = np.add.reduceat(own, first, axis=0, dtype=np.float64) / count
        square = np.add.reduceat(own * own, first, axis=0, dtype=np.float64) / count
        out[rows, :DIM], out[rows, DIM : 2 * DIM] = mean, np.sqrt(np.maximum(square - mean**2, 0))
        out[rows, -2] = np.log1p(count[:, 0])
        out[rows, -1] = np.diff(offsets)[rows] / count[:, 0] / 10
    return out


@dataclass
class Net:
    """Standardised inputs, one hidden layer, one logit, and its temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    heat: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        """The logit counts to nine digits: the last bits of a float product depend on the size of its batch."""
        return 1 / (1 + np.exp(-np.clip(np.round(self.logit(x) / self.heat, 9), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Net:
    """Adam over mini-batches on four fifths; the temperature minimises the log-loss of the rest."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    random = np.random.default_rng(seed)
    order = random.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    if not 0 < y[own].mean() < 1:  # the rest must show both kinds; only a few rows can miss one
        held, own = order[:0], order
    net = Net(x[own].mean(axis=0), x[own].std(axis=0) + 1e-3, random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    names = ("w1", "b1", "w2", "b2")
    m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    z = (x - net.mean) / net.scale
    for _ in range(EPOCHS):
        mixed = random.permutation(own)
        for a in range(0, len(mixed), 256):
            at = mixed[a : a + 256]
            h = np.tanh(z[at] @ net.w1 + net.b1)
            d = (1 / (1 + np.exp(-(h @ net.w2 + net.b2))) - y[at]) / len(at)
            back = d[:, None] * net.w2 * (1 - h * h)
            grads = {"w1": z[at].T @ back + DECAY * net.w1, "b1": back.sum(axis=0), "w2": h.T @ d + DECAY * net.w2, "b2": d.sum()}
            t += 1
            for k in names:
                m[k], v[k] = 0.9 * m[k] + 0.1 * grads[k], 0.999 * v[k] + 0.001 * grads[k] ** 2
                setattr(net, k, getattr(net, k) - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))
    if len(held):
        logit = net.logit(x[held])
        loss = lambda heat: np.logaddexp(0, np.where(y[held] > 0.5, -1, 1) * logit / heat).mean()
        net.heat = float(min(np.geomspace(0.5, 8, 60), key=loss))
    return net


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    net: Net | None  # None unless there are labels of both kinds
    prior: float


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Word vectors from all documents; the network from about ``sample`` labelled rows at most, chosen by a hash of doc_id.
    A document labelled more than once counts with its mean label, one with several rows with the text of the smallest hash. Null labels are left out."""
    vectors = word_vectors(docs)
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    share = sample / max(known.count(), 1)
    chosen = known.where(F.pmod(F.xxhash64(F.col("label_id").cast("string")), F.lit(1_000_003)) / 1_000_003.0 < share)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, limit=STEP_BYTES // 2):
            made = pooled(data, offsets, sent.value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), made.shape[1]).cast(pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    # ``chosen`` holds no more than about ``sample`` rows of two numbers; of an id's rows one is learned from
    pairs = texts_of(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = sorted(pairs.mapInArrow(work, "doc_id long, y double, x array<float>").collect(), key=lambda r: (r.doc_id, r.x))
    y = np.array([r.y for r in rows])
    prior = float(y.mean()) if len(y) else 0.5
    net = fit(np.array([r.x for r in rows]), y) if len(y) and 0 < prior < 1 else None
    return Model(vectors, net, prior)


def scored(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out`` (0 to 1), which replaces a column of that name. Null and empty texts have no words and get what the network gives for none.
    Without labels of both kinds there is no network and no evidence, so every text scores 1 and none is rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != out]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part, data, offsets in slices(batches, limit=STEP_BYTES // 2):
            x = pooled(data, offsets, model.vectors)
            value = model.net.score(x) if model.net else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(value.astype(np.float64))], [*rest, out])

    own = docs.select(*[F.col(f"`{c}`") for c in rest])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(work, f"{kinds}, `{out}` double")


def classify(docs: DataFrame, labels: DataFrame, held_out_of: int = 4, held_out: int = 2, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; labels of rows with crc32(doc_id as text) mod ``held_out_of`` equal
    ``held_out`` teach nothing. Rows that repeat get equal results; an empty table gives an empty result."""
    is_held = F.crc32(F.col("doc_id").cast("string")) % held_out_of == held_out
    model = train(docs, labels.where(~is_held), sample)
    made = scored(texts_of(docs), model)
    return made.select("doc_id", is_held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
