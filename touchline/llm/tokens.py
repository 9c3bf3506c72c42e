"""Operator 3: token counts of whole texts without keeping the tokens.

The tokenizer is compiled to a transducer whose transitions carry emitted-token counts (``transducer``). Every text is cut
into chunks. A chunk is a map from the state before it to the state behind it and the tokens it emits: from its first place
where the text parts, both are the same for every state before; what lies before that place is its ``head``. Maps
compose associatively, and a scan over pairs, then pairs of pairs, makes a text's chunks one map.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import slices, texts_of, tokenizer_path
from touchline.llm.transducer import Transducer, transducer

MODEL = "piece_bpe_32k.model"
#: Symbols of a chunk, and bytes of the texts whose chunks are read side by side.
CHUNK, SIDE_BYTES = 512, 2 << 20


def symbols_of(machine: Transducer, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols, each text behind the space that the library puts before it, and their places (n + 1)."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    byte = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
    one = byte[lead]
    point = one.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        at = np.flatnonzero((one >= low) & (one < (low | (mask + 1 if size < 4 else 8))) if size < 4 else one >= low)
        value = one[at] & mask
        for k in range(1, size):
            value = value << 6 | byte[lead[at] + k] & 0x3F
        point[at] = value
    starts = np.searchsorted(lead, offsets)
    full = np.diff(offsets) > 0
    symbol = np.insert(machine.of[point], starts[:-1][full], machine.of[32])
    return symbol, starts + np.concatenate([[0], np.cumsum(full)])


@dataclass
class Maps:
    """State maps of chunks, one after another within their texts: symbols lo to hi; ``sync`` is the first place where the
    text parts (hi if there is none, then the whole chunk is head); ``state`` and ``emitted`` are the exit from there on."""

    text: np.ndarray
    number: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    sync: np.ndarray
    state: np.ndarray
    emitted: np.ndarray


def chunk_maps(machine: Transducer, symbol: np.ndarray, apart: np.ndarray, places: np.ndarray, chunk: int) -> Maps:
    """The maps of all chunks of all texts, read side by side."""
    size = np.diff(places)
    count = -(-size // chunk)
    text = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    lo = places[text] + number * chunk
    hi = np.minimum(lo + chunk, places[text + 1])
    where = np.append(np.flatnonzero(apart), len(symbol))
    sync = np.minimum(where[np.searchsorted(where, lo)], hi)
    state, emitted = machine.run(symbol, apart, np.zeros(len(lo), np.int64), sync, hi)
    return Maps(text, number, lo, hi, sync, state, emitted)


def composed(machine: Transducer, symbol: np.ndarray, apart: np.ndarray, m: Maps) -> Maps:
    """Neighbours within a text as one map each. A head is read once: from the exit state of what comes before it."""
    left = m.number % 2 == 0
    a = np.flatnonzero(left)
    pair = np.append(~left[1:], False)[a] if len(left) else left[a]
    b = a[pair] + 1
    closed = m.sync[a[pair]] < m.hi[a[pair]]
    state, emitted, sync, hi = m.state[a], m.emitted[a], m.sync[a].copy(), m.hi[a].copy()
    own = np.flatnonzero(pair)
    hi[own] = m.hi[b]
    joined, heads = own[closed], b[closed]
    out, made = machine.run(symbol, apart, state[joined], m.lo[heads], m.sync[heads], (state, m.state))
    parts = m.sync[heads] < m.hi[heads]
    state[joined] = np.where(parts, m.state[heads], out)
    emitted[joined] += made + m.emitted[heads]
    opened, other = own[~closed], b[~closed]  # the whole left chunk is head
    sync[opened], state[opened], emitted[opened] = m.sync[other], m.state[other], m.emitted[other]
    return Maps(m.text[a], m.number[a] // 2, m.lo[a], hi, sync, state, emitted)


def counts(machine: Transducer, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Tokens of each text. A text's first place parts from what is before it, so its map ends in one number."""
    machine.trim()
    symbol, places = symbols_of(machine, data, offsets)
    apart = np.ones(len(symbol), bool)
    if len(symbol) > 1:
        apart[1:] = ~machine.near[symbol[:-1], symbol[1:]]
    apart[places[:-1][np.diff(places) > 0]] = True
    maps = chunk_maps(machine, symbol, apart, places, chunk)
    while len(maps.number) and maps.number.max() > 0:
        maps = composed(machine, symbol, apart, maps)
    out = np.zeros(len(offsets) - 1, np.int64)
    out[maps.text] = maps.emitted
    return out


def token_counts(docs: DataFrame, limit: int = 4096, model: str = MODEL) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text, any more columns).

    Null and empty texts have 0 bytes and 0 tokens. Rows that repeat are counted each by itself. Texts of any length go
    the same way. An empty table gives an empty result. Other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_path(model))
        for part, data, offsets in slices(batches, limit=SIDE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(counts(machine, data, offsets))], ["doc_id", "n_bytes", "n_tokens"])

    made = texts_of(docs).mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")
    return made.withColumn("over_limit", F.col("n_tokens") > limit)
