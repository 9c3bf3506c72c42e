"""Operator 9: repeated passages removed by sliding spans of sentences.

A span is a run of several consecutive sentences: two, or as many more as it takes to hold ``min_words`` words. Spans are
taken forward from every sentence and backward from every sentence, so that a repeated passage is covered to its last
sentence. They join globally by two hashes, 96 bits together: the first (smallest doc_id, place) stays, and the sentences of
all others are removed. Short repeated lines and sentences that repeat alone stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import STEP_BYTES, fresh, mix, run_hashes, runs, sequence_hashes, slices, texts_of, written

MIN_WORDS = 16
_SECOND = np.uint64(0xA0761D6478BD642F)
CHARS = 3  # characters that count as one word where a script parts no words
CLOSERS = "\u201d\u2019\u00bb\u203a\uff09\u300d\u300f\u3011\u3009\u300b"
#: Full-width, Arabic, Devanagari, Armenian, Ethiopic, Khmer, Burmese and Tibetan stops end a sentence without white space.
WIDE_STOPS = "\u3002\uff01\uff1f\uff61\uff0e\u061f\u06d4\u0964\u0965\u0589\u1362\u17d4\u104b\u0f0d"
#: Thai, Lao, Burmese, Khmer: white space stands between sentences or clauses, not words.
SPACED_BY_SENTENCE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF))
#: These, Tibetan, kana, Bopomofo and Chinese characters; not Hangul, which parts its words.
UNSPACED = (*SPACED_BY_SENTENCE, (0x0F00, 0x0FFF), (0x3005, 0x3007), (0x3041, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


def _marks(data: np.ndarray, chars: str) -> np.ndarray:
    """Where the bytes of these characters lie; no continuation byte starts one."""
    found = np.zeros(len(data), bool)
    for char in chars:
        code = char.encode()
        at = np.flatnonzero(data == code[0])
        for k, byte in enumerate(code[1:], 1):
            at = at[at + k < len(data)]
            at = at[data[at + k] == byte]
        for k in range(len(code)):
            found[at + k] = True
    return found


def _within(data: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the characters of three or four bytes in these ranges of code points."""
    at = np.flatnonzero(data >= 0xE0)
    size = np.where(data[at] >= 0xF0, 4, 3)
    if not len(at):
        return at, size
    d = np.append(data, np.zeros(3, np.uint8)).astype(np.int64)
    point = ((d[at] & 15) << 12) | ((d[at + 1] & 63) << 6) | (d[at + 2] & 63)
    wide = ((d[at] & 7) << 18) | ((d[at + 1] & 63) << 12) | ((d[at + 2] & 63) << 6) | (d[at + 3] & 63)
    point = np.where(size == 4, wide, point)
    own = np.zeros(len(at), bool)
    for lo, hi in ranges:
        own |= (point >= lo) & (point <= hi)
    return at[own], size[own]


def sentence_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each sentence in ``data`` and its row; the sentences of a text make it up whole.

    A sentence ends at white space with a line feed, behind a stop (``.!?`` and those of other scripts) and closing quotes
    or brackets before white space, behind the stops that need no white space, and at white space behind Thai and other
    scripts that part sentences by it alone. It takes the closing marks and the white space behind it."""
    n = len(data)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.zeros(n, bool)
    if n:
        other = bool((data >= 128).any())
        stop = (data == 46) | (data == 33) | (data == 63)
        close = (data == 34) | (data == 39) | (data == 41) | (data == 93) | (data == 125)
        if other:
            close |= _marks(data, CLOSERS)
            wide = _marks(data, WIDE_STOPS)
            stop |= wide
            passed = close | stop
            at, size = _within(data, SPACED_BY_SENTENCE)
            for k in range(3):
                stop[at + k] = True
        gap_starts, gap_ends, gap_row = runs(white, offsets)
        feeds = np.concatenate([[0], np.cumsum(data == 10)])
        own = np.maximum.accumulate(np.where(close, -1, np.arange(n)))  # the last byte up to here that closes nothing
        before = own[np.maximum(gap_starts - 1, 0)]
        new = (stop[before] & (before >= offsets[gap_row]) & (before < gap_starts)) | (feeds[gap_ends] > feeds[gap_starts])
        starts[gap_ends[new & (gap_ends < n)]] = True
        if other and wide.any():
            ends = np.append(np.flatnonzero(wide[:-1] & ~wide[1:]) + 1, n if wide[-1] else n + 1)
            ends = ends[ends < n]
            row_end = offsets[np.searchsorted(offsets, ends - 1, side="right")]
            after = lambda mask: np.minimum.accumulate(np.append(np.where(mask, n, np.arange(n)), n)[::-1])[::-1]
            begin = after(white)[after(passed)[ends]]
            starts[begin[begin < row_end]] = True
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(starts)
    return at, np.searchsorted(offsets, at, side="right") - 1


def words(data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: parted by white space and by sentence starts ``at``; of scripts that part no words, each
    CHARS characters in a row count as one."""
    white = (data == 32) | ((data >= 9) & (data <= 13))
    starts, ends, _ = runs(~white, offsets)
    char, size = _within(data, UNSPACED) if (data >= 0xE0).any() else (starts[:0], starts[:0])
    if not len(char) and not len(np.setdiff1d(at[~white[at]], starts, assume_unique=True)):
        return starts, ends
    first = np.zeros(len(data), bool)
    first[at] = True
    new = np.ones(len(char), bool)
    new[1:] = (char[1:] != char[:-1] + size[:-1]) | first[char[1:]]
    place = np.arange(len(char)) - np.maximum.accumulate(np.where(new, np.arange(len(char)), 0)) if len(char) else char
    begin = np.zeros(len(data) + 1, bool)
    begin[starts] = True
    begin[at[~white[at]]] = True
    begin[char[place % CHARS == 0]] = True
    begins = np.flatnonzero(begin)
    return begins, np.minimum(np.append(begins[1:], len(data)), ends[np.searchsorted(starts, begins, side="right") - 1])


def spans(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the first sentence in its text, number of sentences, and two hashes (64 and 32 bits) of each span."""
    at, row = sentence_bounds(data, offsets)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, none, none.astype(np.int32)
    word_at, word_end = words(data, offsets, at)
    if not len(word_at):
        return none, none, none, none, none.astype(np.int32)
    first = np.searchsorted(word_at, at)
    last = np.append(first[1:], len(word_at))
    some = last > first
    begin = np.where(some, word_at[np.minimum(first, len(word_at) - 1)], at)
    end = np.where(some, word_end[np.maximum(last - 1, 0)], at)
    value = run_hashes(data, begin, end)
    total = np.append(first, len(word_at))  # words before each sentence
    opens, closes = np.searchsorted(row, row), np.searchsorted(row, row, side="right")
    here = np.arange(len(at))
    to = np.maximum(np.searchsorted(total, total[:-1] + min_words), here + 2)  # forward from each sentence
    ahead = to <= closes
    back = np.minimum(np.searchsorted(total, total[1:] - min_words, side="right") - 1, here - 1)  # backward from each sentence
    behind = back >= opens
    pairs = np.concatenate([here[ahead] * (len(at) + 1) + to[ahead], back[behind] * (len(at) + 1) + here[behind] + 1])
    pairs = np.unique(pairs)
    a, b = pairs // (len(at) + 1), pairs % (len(at) + 1)
    other = (sequence_hashes(mix(value ^ _SECOND), a, b) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return row[a], a - opens[a], b - a, sequence_hashes(value, a, b).view(np.int64), other


def gathered(ids: pa.Array, texts: pa.Array, row: np.ndarray, number: np.ndarray, size: np.ndarray, value: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    """One row for each text and distinct span: its hashes h and g, doc_id, text hash t, first place s, sentences n, and
    ``more`` places in rising order (null for none). A passage that a text holds many times so counts once in the join."""
    order = np.lexsort((number, size, other, value, row))
    row, number, size, value, other = row[order], number[order].astype(np.int32), size[order].astype(np.int32), value[order], other[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1]) | (other[1:] != other[:-1]) | (size[1:] != size[:-1])
    at = np.flatnonzero(new)
    extra = np.diff(np.append(at, len(row))) - 1
    ends = np.append(0, np.cumsum(extra)).astype(np.int32)
    more = pa.ListArray.from_arrays(pa.array(ends), pa.array(number[~new]), mask=pa.array(extra == 0)) if len(at) else pa.array([], pa.list_(pa.int32()))
    own = pa.array(row[at])
    return pa.RecordBatch.from_arrays([pa.array(value[at]), pa.array(other[at]), ids.take(own), texts.take(own), pa.array(number[at]), pa.array(size[at]), more], ["h", "g", "doc_id", "t", "s", "n", "more"])


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with text cut, and n_removed (sentences) and removed_words; all other columns stay, whatever their names.

    Null stays null and empty stays empty, with 0 removed. Rows that repeat a doc_id and a text count as one document for
    the choice of the first span and are cut alike; rows of one doc_id with different texts are documents of their own. A null
    doc_id comes before all others. Texts of any length are taken whole; an empty table gives an empty result. Columns of
    docs named n_removed or removed_words are replaced.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, limit=STEP_BYTES):
            yield gathered(part.column("doc_id"), part.column("t"), *spans(data, offsets, min_words))

    text_hash = F.hash("text")
    made = texts_of(docs, text_hash.alias("t")).mapInArrow(emit, "h long, g int, doc_id long, t int, s int, n int, more array<int>")
    made = written(made, "spans")
    where = F.struct("doc_id", "t", "s")
    last = F.struct("doc_id", "t", F.coalesce(F.element_at("more", -1), "s"))
    # written, so that the join deals its own two sides: a small one is sent whole, a skewed one is split at run time
    repeated = written(made.groupBy("h", "g").agg(F.min(where).alias("first"), F.max(last).alias("last")).where("first < last").select("h", "g", "first"), "repeated")
    other = ~where.eqNullSafe(F.col("first"))
    again = made.join(repeated, ["h", "g"]).where(other | F.col("more").isNotNull()).select("doc_id", "t", F.when(other, F.col("s")).alias("s"), "n", "more")
    cuts = again.groupBy("doc_id", "t").agg(F.collect_set(F.struct("s", "n", "more")).alias("cut_at"))  # no more than twice a text's sentences

    rest = [c for c in docs.columns if c not in ("n_removed", "removed_words")]
    cut_at, cut_id, cut_text = (fresh(c, rest) for c in ("cut_at", "cut_id", "cut_text"))
    cuts = cuts.select(F.col("doc_id").alias(cut_id), F.col("t").alias(cut_text), F.col("cut_at").alias(cut_at))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(cut_id)) & (text_hash == F.col(cut_text))
    joined = docs.select(*[F.col(f"`{c}`") for c in rest]).join(cuts, same, "left").drop(cut_id, cut_text)
    place = rest.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, limit=STEP_BYTES):
            at, row = sentence_bounds(data, offsets)
            bounds = np.append(at, len(data))
            first = np.searchsorted(row, np.arange(part.num_rows + 1))
            word_at = words(data, offsets, at)[0] if len(at) else at
            count = np.diff(np.searchsorted(word_at, bounds))  # words of each sentence
            texts, removed, gone_words = part.column("text").to_pylist(), [], []
            for k, gone in enumerate(part.column(cut_at).to_pylist()):
                if not gone:
                    removed.append(0)
                    gone_words.append(0)
                    continue
                out = np.zeros(first[k + 1] - first[k], bool)
                for span in gone:
                    for s in (*([] if span["s"] is None else [span["s"]]), *(span["more"] or [])):
                        out[s : s + span["n"]] = True
                parts = [data[bounds[first[k] + i] : bounds[first[k] + i + 1]].tobytes() for i in range(len(out))]
                texts[k] = b"".join(p for p, o in zip(parts, out, strict=True) if not o).decode()
                removed.append(int(out.sum()))
                gone_words.append(int(count[first[k] : first[k + 1]][out].sum()))
            columns = [part.column(c) for c in rest]
            columns[place] = pa.array(texts, part.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64()), pa.array(gone_words, pa.int64())], [*rest, "n_removed", "removed_words"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in rest]).schema)
    return joined.mapInArrow(cut, f"{kinds}, n_removed long, removed_words long")
