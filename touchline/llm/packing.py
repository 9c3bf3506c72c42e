"""Operator 6: best-two-fit packing of documents into sequences of bounded length.

A bin is filled greedily with the largest piece that fits. Then its smallest piece gives way to two
unpacked pieces, if some two fill the gap that it leaves more tightly. Pieces are dealt at random to
groups of bounded size, each packed by one task; a group wastes about one sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import STEP_BYTES, slices, texts_of, tokenizer_path, written
from touchline.llm.segments import byte_bpe

MODEL, CAPACITY, GROUP = "byte_bpe_50k.json", 2048, 60_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int | None = 0, model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: longer ones are cut from the end, so the first piece may be shorter."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_bpe(tokenizer_path(model))
        for batch, data, offsets in slices(batches, limit=STEP_BYTES):
            made, at = tokenizer.encode(data, offsets)
            if end_id is not None:
                made, at = np.insert(made, at[1:], end_id), at + np.arange(len(at))
            made, size = made.astype("<u4"), np.diff(at)
            pieces = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = size - (pieces - 1) * capacity
            start = np.where(number > 0, head[row] + (number - 1) * capacity, 0)
            length = np.where(number > 0, capacity, head[row])
            first = at[row] + start
            raw = memoryview(made.tobytes())
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first, first + length, strict=True)], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([made[a:b].astype(np.int32) for a, b in zip(first, first + length, strict=True)], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts_of(docs).mapInArrow(work, PIECES + (", ids array<int>" if with_ids else ""))


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to ``capacity``)."""
    by: dict[int, list[int]] = {}
    for place in range(len(lengths) - 1, -1, -1):
        by.setdefault(int(lengths[place]), []).append(place)
    have = mirror = 0  # bit x: some length x is unpacked; bit capacity - x: the same, mirrored
    for x in by:
        have |= 1 << x
        mirror |= 1 << (capacity - x)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(x: int) -> int:
        nonlocal have, mirror
        place = by[x].pop()
        if not by[x]:
            have &= ~(1 << x)
            mirror &= ~(1 << (capacity - x))
        return place

    def give(x: int, place: int) -> None:
        nonlocal have, mirror
        by[x].append(place)
        have |= 1 << x
        mirror |= 1 << (capacity - x)

    def two(total: int) -> tuple[int, int] | None:
        """Two unpacked lengths with just that sum."""
        both = have & (mirror >> (capacity - total))
        if total % 2 == 0 and both >> (total // 2) & 1 and len(by[total // 2]) < 2:
            both &= ~(1 << (total // 2))
        if not both:
            return None
        a = both.bit_length() - 1
        return a, total - a

    number = 0
    while have:
        held, gap = [], capacity
        while fits := have & ((2 << gap) - 1):
            x = fits.bit_length() - 1
            held.append((x, take(x)))
            gap -= x
        if gap and have:
            x, place = held[-1]  # the smallest, as each fill is no larger than the one before
            for total in range(min(gap + x, capacity), x, -1):
                if found := two(total):
                    held[-1:] = [(y, take(y)) for y in found]
                    give(x, place)
                    break
        offset = 0
        for x, place in held:
            bins[place], offsets[place] = number, offset
            offset += x
        number += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``pieces`` is read twice (counted, then packed) and dealt into groups by its piece_row."""
    groups = max(1, -(-pieces.count() // group))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if batches:
            whole = pa.Table.from_batches(batches)
            bins, offsets = best_two_fit(whole.column("length").to_numpy(), capacity)
            whole = whole.append_column("sequence_id", pa.array((TaskContext.get().partitionId() << 32) + bins)).append_column("offset", pa.array(offsets))
            yield from whole.to_batches()

    dealt = pieces.repartition(groups, F.xxhash64("piece_row"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(work, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int | None = 0, model: str = MODEL, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset for every piece of every document.

    Null and empty texts give one piece with the end id alone. Repeated rows are packed each by
    itself, other columns are ignored, and an empty table gives an empty result.
    """
    made = written(cut_pieces(docs, capacity, end_id, model, with_ids).withColumn("piece_row", F.monotonically_increasing_id()), "pieces")
    packed = pack_pieces(made.drop("ids"), capacity, group)
    if with_ids:  # packing holds a group's pieces at once, so their ids stay behind and join them afterwards
        packed = packed.join(made.select("piece_row", "ids"), "piece_row")
    return packed.select(*[f.split()[0] for f in PIECES.split(", ")], *(["ids"] if with_ids else []), "sequence_id", "offset")
