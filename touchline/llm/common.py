"""Helpers that the operators of this package share: shared work folders and text batches."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import touchline

#: Text bytes that a numpy step handles at once; its temporaries take some tens of times as much.
CHUNK_BYTES = 4 << 20

#: The same for steps that keep several numbers for each byte or word.
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, a local master (tests) gets a local one and any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-touchline-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/touchline-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: a short lineage that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_touchline_sent", False):
        return
    root = Path(touchline.__file__).parent
    to = Path(tempfile.mkdtemp(prefix="spark-touchline-")) / "touchline_package.zip"
    with zipfile.ZipFile(to, "w") as file:
        for path in sorted(root.rglob("*.py")):
            file.write(path, Path("touchline") / path.relative_to(root))
    context.addPyFile(str(to))
    context._touchline_sent = True


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or one with underscores behind it that no column of ``taken`` has."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def texts_of(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id as long, text with null as empty, and the columns named; other columns go."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets, from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` text bytes (one longer row stays whole) with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of True in ``inside``; no run crosses a row's end."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~inside[1:] | first[1:]
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of unsigned values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base & 0xFFFFFFFFFFFFFFFF
    with np.errstate(over="ignore"):
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(step)
            done, step = done + more, step * step & 0xFFFFFFFFFFFFFFFF
    return out


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end] by differences of one running polynomial; runs may overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    global _UP, _DOWN
    if len(_UP) < len(values) + 1:
        _UP, _DOWN = _powers(_BASE, len(values) + 1), _powers(_INVERSE, len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _UP[: len(values)], out=total[1:])
        value = (total[ends] - total[starts]) * _DOWN[starts]
        return mix(value ^ ((ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes data[start:end] of each run."""
    return sequence_hashes(_BYTE[data], starts, ends)


_UP, _DOWN = np.ones(1, np.uint64), np.ones(1, np.uint64)


def encoded(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The pieces data[cuts[i]:cuts[i + 1]] as codes into a list of the distinct ones."""
    flat = np.ascontiguousarray(data)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(flat)])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a text holds a letter; other numerals, which the pattern also finds, are none."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))
