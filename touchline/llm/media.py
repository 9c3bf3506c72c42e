"""Operator 2: audio features of media columns.

A clip is an 8-bit PCM WAV file in a Parquet table. Its samples, less their mean, are resampled by a polyphase filter, cut
into overlapped windows and reduced to log-mel energies; hysteresis around the clip's own level gives the active segments.
Features are stored as Arrow streams of fixed-shape tensors (FRAMES x MELS) with time spans, some hundred clips to a row of
a Parquet table. Clips are worked through in blocks of one shape, so equal clips have equal features wherever they lie.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import shared_dir, ship, slices, texts_of

UNIT, RATE, DOWN, TAPS = 192, 16_000, 2, 16
WINDOW, HOP, MELS, FRAMES = 256, 128, 32, 16
#: Hysteresis on a frame's root mean square over that of the whole clip; a clip below SILENT (full scale is 1) has no segment.
LOUD, QUIET, SILENT = 1.05, 0.95, 1e-4
#: Log-mel energies are kept to steps of 1 / FINE, about a hundredth of a decibel, which halves what a stored tensor takes.
FINE = 256
TENSOR = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
#: Bytes of tensors after which a shard is closed.
SHARD_BYTES = 4 << 20
CLIPS = "doc_id long, n_bytes long, media binary"
SHARDS = "n_clips long, clips binary, blocks binary"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of UNIT."""
    return text + b" " * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM file; a chunk of odd size is padded as the format asks."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def from_wav(stored: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono 8-bit PCM file, whatever chunks lie before the data."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        if name == b"data":
            return stored[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=4)
def filters(rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The low-pass filter split into DOWN phases, the analysis window, and the mel filterbank."""
    t = np.arange(TAPS * DOWN) - (TAPS * DOWN - 1) / 2
    low = np.sinc(t / DOWN) * np.hamming(TAPS * DOWN) / DOWN
    phases = (low / low.sum()).reshape(TAPS, DOWN).T.astype(np.float32)
    new = rate / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(new / 2), MELS + 2) / 2595) - 1)
    f = np.arange(WINDOW // 2 + 1) * new / WINDOW
    bank = [np.maximum(0, np.minimum((f - a) / (b - a), (c - f) / (c - b))) for a, b, c in zip(edges, edges[1:], edges[2:], strict=False)]
    return phases, np.hanning(WINDOW).astype(np.float32), np.array(bank, np.float32).T.copy()


def frames_of(samples: bytes) -> int:
    return max(1, -(-(-(-len(samples) // DOWN) - WINDOW) // HOP) + 1)


def blocks(samples: bytes, rate: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Log-mel energies (FRAMES x MELS), each frame's loudness, and how many frames are within the clip. What lies outside the
    clip is silence."""
    phases, window, bank = filters(rate)
    raw = np.frombuffer(samples, np.uint8)
    mean = np.float32(raw.mean()) if len(raw) else np.float32(0)
    frames = frames_of(samples)
    need = (FRAMES - 1) * HOP + WINDOW  # resampled samples of a block
    for first in range(0, frames, FRAMES):
        lo = first * HOP * DOWN - TAPS * DOWN // 2
        x = np.zeros(need * DOWN + TAPS * DOWN, np.float32)
        a, b = max(lo, 0), min(lo + len(x), len(raw))
        x[a - lo : b - lo] = (raw[a:b] - mean) / np.float32(128)
        y = np.zeros(need, np.float32)
        for k in range(DOWN):
            y += np.convolve(x[k::DOWN][: need + TAPS - 1], phases[k, ::-1], "valid")
        cut = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
        power = np.abs(np.fft.rfft(cut * window, axis=1)) ** 2
        mel = np.log(power.astype(np.float32) @ bank + 1e-6)
        yield np.rint(mel * FINE) / np.float32(FINE), np.sqrt((cut * cut).mean(axis=1)), min(FRAMES, frames - first)


def active(loud: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges that start at LOUD times the clip's level and go on down to QUIET times it."""
    level = float(np.sqrt((loud.astype(np.float64) ** 2).mean())) if len(loud) else 0.0
    if level < SILENT:
        return []
    state = np.where(loud >= LOUD * level, 1, np.where(loud < QUIET * level, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.append(0, (known >= 0) & (state[np.maximum(known, 0)] == 1))
    edge = np.flatnonzero(np.diff(np.append(on, 0)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(samples: bytes, rate: int) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """A clip's tensors (blocks x FRAMES x MELS), their time spans, and those of its active segments. A block's frames behind
    the clip's end are silence and lie outside its span."""
    made, loud, sizes = zip(*blocks(samples, rate), strict=True)
    step = HOP * DOWN / rate
    starts = np.arange(len(sizes)) * FRAMES
    spans = [(a * step, (a + n) * step) for a, n in zip(starts.tolist(), sizes, strict=True)]
    found = active(np.concatenate([x[:n] for x, n in zip(loud, sizes, strict=True)]))
    return np.stack(made), spans, [(a * step, b * step) for a, b in found]


def write_clips(docs: DataFrame, path: str) -> None:
    """Every text's padded bytes as a WAV file in a Parquet table: doc_id, n_bytes (unpadded), media."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            raw = data.tobytes()
            clips = pa.array([to_wav(payload_of(raw[a:b])) for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), clips], ["doc_id", "n_bytes", "media"])

    texts_of(docs).mapInArrow(work, CLIPS).write.option("compression", "zstd").parquet(path)


def stream(table: pa.Table) -> bytes:
    """A table as an Arrow stream with compressed buffers."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(table)
    return sink.getvalue().to_pybytes()


_SPAN = pa.struct([("from_s", pa.float64()), ("to_s", pa.float64())])
_CLIP = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("rate", pa.int64()), ("n_blocks", pa.int64()), ("active", pa.list_(_SPAN))])


def write_features(clips: DataFrame, path: str) -> None:
    """Shards of clips (digests of the stored bytes, active segments) and of their blocks (tensor, time span).

    A clip's blocks stand in one shard, in order. Null clips are left out, an empty table gives no shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, tensors, spans, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            flat = np.concatenate(tensors).reshape(-1)
            list_type = pa.FixedSizeListArray.from_arrays(pa.array(flat), FRAMES * MELS)
            whole = pa.table({"mel": pa.ExtensionArray.from_storage(TENSOR, list_type), "start_s": pa.array([a for a, _ in spans], pa.float64()), "end_s": pa.array([b for _, b in spans], pa.float64())})
            values = [[len(rows)], [stream(pa.Table.from_pylist(rows, _CLIP))], [stream(whole)]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["n_clips", "clips", "blocks"])

        for batch in batches:
            for name, size, clip in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
                stored = clip.as_py()
                if stored is None:
                    continue
                samples, rate = from_wav(stored)
                mel, own, found = features(samples, rate)
                rows.append({"doc_id": name, "n_bytes": size, "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-16:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "rate": rate, "n_blocks": len(mel), "active": [{"from_s": a, "to_s": b} for a, b in found]})
                tensors.append(mel)
                spans += own
                held += mel.nbytes
                if held >= SHARD_BYTES:
                    yield shard()
                    rows, tensors, spans, held = [], [], [], 0
        if rows:
            yield shard()

    ship(clips.sparkSession)
    clips.select("doc_id", "n_bytes", "media").mapInArrow(work, SHARDS).write.parquet(path)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table, np.ndarray]]:
    """Clips, blocks and tensors (n x FRAMES x MELS) of each shard."""
    for batch in batches:
        for clips, made in zip(batch.column("clips"), batch.column("blocks"), strict=True):
            tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in (clips, made)]
            yield *tables, tables[1].column("mel").combine_chunks().to_numpy_ndarray()


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A row for each stored block: doc_id, block, mel (FRAMES * MELS floats), shape, start_s, end_s, and the clip's active segments."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for clips, made, tensors in opened(batches):
            count = clips.column("n_blocks").to_numpy()
            row = np.repeat(np.arange(len(count)), count)
            number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            mel = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), FRAMES * MELS).cast(pa.list_(pa.float32()))
            columns = [clips.column("doc_id").combine_chunks().take(pa.array(row)), pa.array(number), mel, pa.array([[FRAMES, MELS]] * len(row), pa.list_(pa.int32())), *[made.column(c).combine_chunks() for c in ("start_s", "end_s")], clips.column("active").combine_chunks().take(pa.array(row))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "block", "mel", "shape", "start_s", "end_s", "active"])

    ship(spark)
    span = "array<struct<from_s: double, to_s: double>>"
    return spark.read.schema(SHARDS).parquet(path).mapInArrow(work, f"doc_id long, block long, mel array<float>, shape array<int>, start_s double, end_s double, active {span}")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """A row for each stored clip: its digests and a feature summary taken from the stored tensors and spans: frames, active
    segments and frames, and the mean log-mel level in sixteenths."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for clips, made, tensors in opened(batches):
            start, end = made.column("start_s").to_numpy(), made.column("end_s").to_numpy()
            at, lines = 0, []
            for rate, count, spans in zip(*[clips.column(c).to_pylist() for c in ("rate", "n_blocks", "active")], strict=True):
                step = HOP * DOWN / rate
                sizes = np.rint((end[at : at + count] - start[at : at + count]) / step).astype(int)
                within = np.arange(FRAMES) < sizes[:, None]
                level = float(np.rint(tensors[at : at + count][within].astype(np.float64) * 16).sum()) / (sizes.sum() * MELS)
                busy = round(sum(s["to_s"] - s["from_s"] for s in spans) / step)
                lines.append(f"frames={sizes.sum()};segments={len(spans)};active={busy};level={level:.3f}")
                at += count
            own = clips.select([f.split()[0] for f in SCHEMA.split(", ")[:-1]]).append_column("feature", pa.array(lines, pa.string()))
            yield from own.to_batches()

    ship(spark)
    return spark.read.schema(SHARDS).parquet(path).mapInArrow(work, SCHEMA)


def media_digests(docs: DataFrame) -> DataFrame:
    """Every text stored as a clip, its features made from the stored clip and stored, and both read back: sizes, digests and a
    feature summary per row.

    Null and empty texts give one unit of spaces. Rows that repeat give equal values, an empty table gives
    an empty result, and other columns are ignored. A clip of over 2 GB is beyond a Parquet cell.
    """
    spark, base = docs.sparkSession, shared_dir(docs.sparkSession)
    write_clips(docs, f"{base}/clips")
    write_features(spark.read.schema(CLIPS).parquet(f"{base}/clips"), f"{base}/features")
    return read_digests(spark, f"{base}/features")
