"""Operator 5: token ids in binary files of patched frame-of-reference blocks.

A shard holds the ids of consecutive documents: magic, counts, the index of block starts, then
blocks. A block takes its minimum off, packs what is left at the width that holds most values
(a percentile) and lists the outliers with their places. Shards are rows of a Parquet table, so any
file system that Spark writes can hold them, with an index of documents beside each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.common import shared_dir, slices, texts_of, tokenizer_path
from touchline.llm.segments import byte_bpe

MODEL = "byte_bpe_50k.json"
MAGIC, HEAD, BLOCK_HEAD = b"PFR1", struct.Struct("<4sQI"), struct.Struct("<IBHH")
BLOCK, PERCENTILE, SHARD_IDS = 1024, 90, 1 << 18
SCHEMA = "part long, shard long, n_ids long, doc_ids array<long>, sizes array<long>, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """One shard's bytes for unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    bodies: list[bytes] = [b""] * blocks
    full = np.resize(ids, blocks * BLOCK).astype(np.int64).reshape(blocks, BLOCK) if n else np.zeros((0, BLOCK), np.int64)
    if n % BLOCK:
        full[-1, n % BLOCK :] = ids[n - n % BLOCK]
    low = full.min(axis=1) if blocks else np.zeros(0, np.int64)
    rest = full - low[:, None]
    at = np.sort(rest, axis=1)[:, BLOCK * PERCENTILE // 100] if blocks else low
    widths = np.array([int(x).bit_length() for x in at], np.int64)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        part = rest[rows]
        over = part >> width > 0
        packed = np.packbits(((part[:, :, None] >> np.arange(width)) & 1).astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little") if width else None
        for k, row in enumerate(rows):
            count = min(BLOCK, n - int(row) * BLOCK)
            places = np.flatnonzero(over[k, :count])
            body = packed[k, : (count * int(width) + 7) // 8].tobytes() if width else b""
            bodies[row] = BLOCK_HEAD.pack(int(low[row]), int(width), count, len(places)) + body + places.astype("<u2").tobytes() + (part[k, places] >> width).astype("<u4").tobytes()
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])[:-1].astype("<u8")
    return HEAD.pack(MAGIC, n, blocks) + starts.tobytes() + b"".join(bodies)


def unpack(shard: bytes) -> np.ndarray:
    """The ids of one shard."""
    magic, n, blocks = HEAD.unpack_from(shard)
    if magic != MAGIC:
        raise ValueError("not a shard of packed ids")
    starts = np.frombuffer(shard, "<u8", blocks, HEAD.size).astype(np.int64) + HEAD.size + 8 * blocks
    heads = [BLOCK_HEAD.unpack_from(shard, s) for s in starts]
    out = np.zeros(blocks * BLOCK, np.int64).reshape(blocks, BLOCK)
    raw = np.frombuffer(shard, np.uint8)
    by: dict[tuple[int, int], list[int]] = {}
    for row, (_, width, count, _) in enumerate(heads):
        by.setdefault((width, count), []).append(row)
    for (width, count), rows in by.items():
        if width:
            size = (count * width + 7) // 8
            bits = np.unpackbits(raw[starts[rows][:, None] + BLOCK_HEAD.size + np.arange(size)], axis=1, bitorder="little")[:, : count * width]
            bits = bits.reshape(len(rows), count, width)
            for k in range(width):
                out[rows, :count] += bits[:, :, k].astype(np.int64) << k
    for row, (low, width, count, odd) in enumerate(heads):
        if odd:
            at = int(starts[row]) + BLOCK_HEAD.size + (count * width + 7) // 8
            out[row, np.frombuffer(shard, "<u2", odd, at)] |= np.frombuffer(shard, "<u4", odd, at + 2 * odd).astype(np.int64) << width
        out[row, :count] += low
    return out.reshape(-1)[:n].astype(np.uint32)


def encode_docs(docs: DataFrame, end_id: int | None = 2, model: str = MODEL, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards of all documents' ids in ascending doc_id order (``part``, then ``shard``).

    Null and empty texts give the end id alone (or nothing). Rows with the same doc_id stay
    neighbours, ordered by text. Other columns are ignored; an empty table gives no shard.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = byte_bpe(tokenizer_path(model)), TaskContext.get().partitionId()
        held, ids, sizes, count, shard = [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            flat = np.concatenate(held) if held else np.zeros(0, np.uint32)
            values = [[part], [shard], [len(flat)], [ids], [sizes], [pack(flat)]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "shard", "n_ids", "doc_ids", "sizes", "payload"])

        for batch, data, offsets in slices(batches):
            made, at = tokenizer.encode(data, offsets)
            if end_id is not None:
                made = np.insert(made, at[1:], end_id)
                at = at + np.arange(len(at))
            names, first = batch.column("doc_id").to_pylist(), 0
            for k in range(len(names)):
                if count + at[k + 1] - at[first] >= shard_ids or k == len(names) - 1:
                    held.append(made[at[first] : at[k + 1]])
                    ids += names[first : k + 1]
                    sizes += np.diff(at[first : k + 2]).tolist()
                    count += int(at[k + 1] - at[first])
                    first = k + 1
                    if count >= shard_ids:
                        yield row()
                        held, ids, sizes, count, shard = [], [], [], 0, shard + 1
        if ids:
            yield row()

    ordered = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(work, SCHEMA)


def write_ids(docs: DataFrame, path: str, **options) -> None:
    """Writes the shards of all documents under ``path``."""
    encode_docs(docs, **options).write.parquet(path)


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Per document of the files under ``path``: doc_id, start, n_tokens, and ids (or their ids_crc32)."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    before = parts.select("part", (F.sum("all_ids").over(W.orderBy("part")) - F.col("all_ids")).alias("part_start"))  # a row for each part
    starts = sizes.withColumn("within", F.sum("n_ids").over(W.partitionBy("part").orderBy("shard")) - F.col("n_ids"))
    starts = starts.join(before, "part").select("part", "shard", (F.col("within") + F.col("part_start")).alias("first"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat = unpack(row["payload"]).astype("<u4")
                ends = np.cumsum(np.array(row["sizes"], np.int64))
                pieces = np.split(flat, ends[:-1])
                last = pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()) if digest else pa.array([p.astype(np.int64) for p in pieces], pa.list_(pa.int64()))
                size = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * size), pa.array([row["shard"]] * size), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - row["sizes"]), pa.array(row["sizes"], pa.int64()), last],
                    ["part", "shard", "doc_id", "inner", "n_tokens", "last"],
                )

    last = "long" if digest else "array<long>"
    docs = shards.select("part", "shard", "doc_ids", "sizes", "payload").mapInArrow(work, f"part long, shard long, doc_id long, inner long, n_tokens long, last {last}")
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", F.col("last").alias("ids_crc32" if digest else "ids"))


def token_ids(docs: DataFrame, **options) -> DataFrame:
    """Writes all documents' ids to a new shared folder and returns their digests read back from there."""
    path = f"{shared_dir(docs.sparkSession)}/token_ids"
    write_ids(docs, path, **options)
    return read_ids(docs.sparkSession, path, digest=True)
