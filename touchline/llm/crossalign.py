"""Operator 13: alignment of two tokenizers by postings and a cogroup.

Tokens of both tokenizers lie over the same bytes. Each text becomes pair multiplicities (a, b, how often they
overlap). Added up within each task, they are shuffled by their b id, where a task streams past them and makes each b id's counts. Then the
postings themselves are shuffled by groups of b ids, together with those counts; within a partition Spark's spillable sort puts
the counts of a b id before its postings, so a task takes the maximum and streams the postings past it. What it emits for
documents is summed by document.

A group with more than a partition's share of the postings is split over several, by steps of documents, and its counts go to all
of them. The groups are few and their number is fixed, so a document gets few contributions at any size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import encoded, mix, slices, texts_of, tokenizer_path, written
from touchline.llm.segments import ByteBpe, byte_bpe_cuts

MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Segments that a worker's table holds before it starts anew, postings of a step, and postings of a partition.
KNOWN, STEP, SHARE = 120_000, 1 << 19, 1 << 22
COLUMNS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Strings:
    """Byte strings by number, gathered without a loop."""

    def __init__(self, items: list[bytes]):
        self.size = np.array([len(x) for x in items], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(items), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        """The strings of ``ids``, one after another."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.pool[np.repeat(self.first[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Aligner:
    """Both tokenizers and what they make of each distinct segment of a worker's texts.

    A segment begins at a space behind another character where the pattern of A surely begins a pre-token; no piece of B holds a
    space behind another character (checked), so B's merges do not cross that place either, and both end a token there.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = ByteBpe(path_a)
        self.a.library.encode_special_tokens = True
        code = {shown: byte for byte, shown in self.a.shown.items()}
        names = sorted(self.a.library.get_vocab().items(), key=lambda x: x[1])
        with open(path_a) as file:
            special = {t["id"] for t in json.load(file)["added_tokens"]}
        of_a = [b""] * (names[-1][1] + 1)
        for name, k in names:
            of_a[k] = name.encode() if k in special else bytes(code[c] for c in name)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        of_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.lists = Strings(of_a), Strings(of_b)
        self.digits = Strings([str(k).encode() for k in range(max(len(of_a), len(of_b)))])
        self.parts = all("▁" not in p.lstrip("▁") for p in pieces)
        self.pair = np.int32 if len(of_a) * len(of_b) < 1 << 31 else np.int64
        self._clear()

    def _clear(self) -> None:
        self.a._clear()
        self.known: dict[bytes, int] = {}
        self.text: list[bytes] = []  # groups as text
        self.sizes = np.zeros((1024, 4), np.int64)  # tokens of a and b, groups, links; -1 where the bytes differ
        self.first = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, self.pair)
        self.used = 0

    def align(self, data: np.ndarray, offsets: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Of texts with the ids of both tokenizers (ids, first places): four sizes, -1 where the bytes differ; groups as text; pairs that overlap."""
        n, width = len(offsets) - 1, len(self.lists[0].size)
        length = np.diff(offsets)
        good = np.ones(n, bool)
        for x, (ids, first) in zip(self.lists, (a, b), strict=True):
            total = np.concatenate([[0], np.cumsum(x.size[ids])])[first]
            good &= np.diff(total) == length
            if good.all():
                good &= np.add.reduceat(x.of(ids) != data, offsets[:-1]) == 0
            else:  # lengths differ somewhere: the rest is compared without those texts
                keep = np.repeat(good, np.diff(first))
                own = np.concatenate([[0], np.cumsum(length[good])])
                if good.any():
                    good[good] = np.add.reduceat(x.of(ids[keep]) != data[np.repeat(good, length)], own[:-1]) == 0
        (ids_a, n_a), (ids_b, n_b) = [(ids[np.repeat(good, np.diff(first))], np.diff(first)[good]) for ids, first in (a, b)]
        sizes, shown = np.full((n, 4), -1, np.int64), [b""] * n
        if not good.any():
            return sizes, shown, np.zeros(0, self.pair)
        size_a, size_b = self.lists[0].size[ids_a], self.lists[1].size[ids_b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        low, high = np.searchsorted(end_a, end_b - size_b, side="right"), np.searchsorted(end_a, end_b)
        many = high - low + 1
        upto = np.concatenate([[0], np.cumsum(many)])
        links = np.repeat(ids_b.astype(np.int64) * width, many) + ids_a[np.repeat(low - upto[:-1], many) + np.arange(upto[-1])]
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        # each group's ids of A, then its ids of B; a comma behind each, a bar behind the last of A, a semicolon behind the last of B
        at_a = np.arange(len(ids_a)) + np.searchsorted(of_b, of_a)
        at_b = np.arange(len(ids_b)) + np.searchsorted(of_a, of_b, side="right")
        order, mark = np.zeros(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), 44, np.uint8)
        order[at_a], order[at_b] = ids_a, ids_b
        mark[at_a[np.append(of_a[1:] != of_a[:-1], True)]] = 124
        mark[at_b[np.append(of_b[1:] != of_b[:-1], True)]] = 59
        wide = np.cumsum(self.digits.size[order] + 1)
        text = np.zeros(int(wide[-1]), np.uint8)
        inside = np.ones(len(text), bool)
        inside[wide - 1] = False
        text[inside], text[wide - 1] = self.digits.of(order), mark
        raw = text.tobytes()
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        stop = wide[last_a + last_b - 1]
        for k, x, y in zip(np.flatnonzero(good).tolist(), np.append(0, stop[:-1]).tolist(), (stop - 1).tolist(), strict=True):
            shown[k] = raw[x:y]
        ends = np.cumsum(length[good])
        sizes[good] = np.stack([n_a, n_b, np.diff(np.searchsorted(both, ends, side="right"), prepend=0), np.diff(upto[last_b], prepend=0)], axis=1)
        return sizes, shown, links.astype(self.pair)

    def tokens(self, data: np.ndarray, offsets: np.ndarray, pieces: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids of A for texts with their leading space, and of B for the texts behind that space."""
        made = self.b.encode([x[1:].decode() for x in pieces], num_threads=1)
        size = np.fromiter(map(len, made), np.int64, len(made))
        return self.a.encode(data, offsets), (np.fromiter(chain.from_iterable(made), np.int64, int(size.sum())), np.concatenate([[0], np.cumsum(size)]))

    def aligned(self, pieces: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        data, offsets = np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        return self.align(data, offsets, *self.tokens(data, offsets, pieces))

    def _learn(self, new: list[bytes]) -> None:
        sizes, shown, links = self.aligned(new)
        k, n = len(self.text), len(new)
        while k + n > len(self.first):
            self.first, self.sizes = np.resize(self.first, 2 * len(self.first)), np.resize(self.sizes, (2 * len(self.sizes), 4))
        while self.used + len(links) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(links)] = links
        many = np.maximum(sizes[:, 3], 0)
        self.first[k : k + n], self.sizes[k : k + n] = self.used + np.cumsum(many) - many, sizes
        self.used += len(links)
        self.text += shown
        self.known.update(zip(new, range(k, k + n), strict=True))

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        cut = byte_bpe_cuts(data, offsets)
        cut[1:-1] &= (data[1:] == 32) & (data[:-1] != 32) & self.parts
        cut[offsets] = True
        marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else []
        for row in np.unique(np.searchsorted(offsets, marks, side="right") - 1):  # B reads this character as a space
            cut[offsets[row] + 1 : offsets[row + 1]] = False
        return np.flatnonzero(cut)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], list[tuple[np.ndarray, np.ndarray]]]:
        """Of texts of one byte or more: their four sizes, digests of their groups, and pairs with multiplicities."""
        data, offsets = np.insert(data, offsets[:-1], 32), offsets + np.arange(len(offsets))
        cuts = self.cuts(data, offsets)
        codes, pieces = encoded(data, cuts)
        if len(self.text) > KNOWN:
            self._clear()
        new = [x for x in pieces if x not in self.known]
        if new:
            self._learn(new)
        own = np.array([self.known[x] for x in pieces], np.int64)[codes]
        size, at = self.sizes[own], np.searchsorted(cuts, offsets)
        total = np.add.reduceat(size, at[:-1], axis=0)
        odd = np.logical_or.reduceat(size[:, 0] < 0, at[:-1])
        count = np.where(size[:, 3] > 0, size[:, 3], 0)
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = self.pool[np.repeat(self.first[own] - ends[:-1], count) + np.arange(ends[-1])].astype(np.int64)
        space = len(self.lists[0].size) * len(self.lists[1].size)
        flat += np.repeat(np.repeat(np.arange(len(total)), np.diff(at)), count) * space
        keys, times = np.unique(flat, return_counts=True)
        places = np.searchsorted(keys, np.arange(len(total) + 1) * space)
        keys %= space
        names, digests, pairs = own.tolist(), [], []
        for k in range(len(total)):
            if odd[k]:  # a segment whose bytes differ: the whole text decides
                own_sizes, shown, links = self.aligned([data[offsets[k] : offsets[k + 1]].tobytes()])
                total[k] = np.maximum(own_sizes[0], 0)
                digests.append(hashlib.sha256(shown[0]).hexdigest() if shown[0] else "")
                pairs.append(np.unique(links.astype(np.int64), return_counts=True))
            else:
                digests.append(hashlib.sha256(b";".join([self.text[x] for x in names[at[k] : at[k + 1]]])).hexdigest())
                pairs.append((keys[places[k] : places[k + 1]], times[places[k] : places[k + 1]]))
        return total, digests, pairs


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One table of segments for all tasks of a worker process."""
    return Aligner(path_a, path_b)


def tokenized(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """One row per document: a row number, its sizes and digest, and its pairs (b * |A| + a) with their multiplicities.
    Written, so that row numbers and tokens outlive executors and are made once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(tokenizer_path(model_a), tokenizer_path(model_b))
        row = TaskContext.get().partitionId() << 40
        for part, data, offsets in slices(batches, limit=1 << 20):
            n = part.num_rows
            full = np.flatnonzero(np.diff(offsets))
            sizes, digests, pairs = np.zeros((n, 4), np.int64), np.full(n, "", object), [np.zeros(0, np.int64)] * n
            times = list(pairs)
            if len(full):
                made, names, found = both.rows(data, np.append(offsets[full], offsets[-1]))
                sizes[full], digests[full] = made, names
                for k, (x, m) in zip(full, found, strict=True):
                    pairs[k], times[k] = x, m
            lengths = np.concatenate([[0], np.cumsum([len(x) for x in pairs])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(lengths, pa.array(np.concatenate(x).astype(kind))) for x, kind in ((pairs, np.int64), (times, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), part.column("doc_id"), *[pa.array(c) for c in sizes.T], pa.array(digests, pa.string()), *lists], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
            row += n

    return written(texts_of(docs).mapInArrow(work, f"{COLUMNS}, pairs array<long>, times array<long>"), "tokenized")


def flat_lists(batch: pa.RecordBatch, *names: str, step: int = STEP) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of rows with about ``step`` list entries: the rows' lengths and their entries of each list column."""
    lists = [batch.column(c) for c in names]
    ends = np.concatenate([[0], np.cumsum(np.nan_to_num(lists[0].value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
    values = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
    at = 0
    while at < batch.num_rows:
        to = min(max(int(np.searchsorted(ends, ends[at] + step, side="right")) - 1, at + 1), batch.num_rows)
        yield np.arange(at, to), np.diff(ends[at : to + 1]), *[v[ends[at] : ends[to]] for v in values]
        at = to


def pair_counts(table: DataFrame, model_a: str = MODEL_A) -> DataFrame:
    """a, b, n over all rows of a ``tokenized`` table: how many links hold each pair of ids."""
    width = _width(model_a)
    pairs = table.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    return pairs.groupBy((F.col("p.pairs") % width).alias("a"), F.floor(F.col("p.pairs") / width).alias("b")).agg(F.sum("p.times").alias("n"))


@lru_cache(maxsize=4)
def _width(model: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer_path(model)).get_vocab().values()) + 1


def counted(table: DataFrame, width: int, most: int = 1 << 21) -> DataFrame:
    """b, posts, a, n: of each b id its number of postings and, packed, its pairs' a ids with their counts over all documents.

    A task adds its pairs up before it sends them; behind the shuffle by b a task streams past the sums, one b id after another."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner.cache_clear()  # the tokenizers' tables are not needed any more
        held, sums, posts = (np.zeros(0, np.int64) for _ in range(3))

        def out() -> Iterator[pa.RecordBatch]:
            at = np.append(np.flatnonzero(np.diff(held // width, prepend=-1)), len(held)).tolist()
            rows = [(int(held[s]) // width, int(posts[s:e].sum()), (held[s:e] % width).astype("<u4").tobytes(), sums[s:e].astype("<i8").tobytes()) for s, e in zip(at[:-1], at[1:], strict=True)]
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 4096], strict=True)], ["b", "posts", "a", "n"])

        for batch in batches:
            for _, _, keys, times in flat_lists(batch, "pairs", "times"):
                held, back = np.unique(np.concatenate([held, keys]), return_inverse=True)
                made = []
                for old, more in ((sums, times), (posts, np.ones(len(keys), np.int64))):
                    added = np.zeros(len(held), np.int64)
                    np.add.at(added, back, np.concatenate([old, more]))
                    made.append(added)
                sums, posts = made
                if len(held) > most:
                    yield from out()
                    held, sums, posts = held[:0], sums[:0], posts[:0]
        yield from out()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, now, posts = np.zeros(width, np.int64), None, 0

        def out() -> pa.RecordBatch:
            a = np.flatnonzero(count)
            made = pa.RecordBatch.from_arrays([pa.array([now]), pa.array([posts]), pa.array([a.astype("<u4").tobytes()]), pa.array([count[a].astype("<i8").tobytes()])], ["b", "posts", "a", "n"])
            count[a] = 0
            return made

        for batch in batches:
            for b, more, a, n in zip(*[batch.column(c).to_pylist() for c in ("b", "posts", "a", "n")], strict=True):
                if b != now and now is not None:
                    yield out()
                    posts = 0
                now, posts = b, posts + more
                count[np.frombuffer(a, "<u4")] += np.frombuffer(n, "<i8")
        if now is not None:
            yield out()

    kind = "b long, posts long, a binary, n binary"
    parts = table.select("pairs", "times").mapInArrow(partial, kind)
    return written(parts.repartition("b").sortWithinPartitions("b").mapInArrow(whole, kind), "counts")


#: Groups of b ids: a document's postings go to so many partitions at most, however many there are.
GROUPS = 8


def dealt(counts: DataFrame, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """The group of each b id, and where each group's partitions begin (groups + 1).

    The driver sees one number for each b id, so no more than the vocabulary. Ids go, the largest first, to the group that has least;
    a group has a partition for each ``share`` of its postings, and steps of documents are spread over them. A b id with a third
    of all postings makes a group with more partitions, not a larger partition."""
    sizes = counts.select("b", "posts").toArrow()
    ids, n = sizes.column("b").to_numpy(), sizes.column("posts").to_numpy()
    group, load = np.zeros(int(ids.max(initial=0)) + 1, np.int64), [(0, g) for g in range(GROUPS)]
    total = np.zeros(GROUPS, np.int64)
    for k in np.argsort(-n, kind="stable"):
        size, g = load[0]
        heapq.heapreplace(load, (size + int(n[k]), g))
        group[ids[k]] = g
        total[g] += n[k]
    return group, np.concatenate([[0], np.cumsum(np.maximum(-(-total // share), 1))])


PACKED = "part int, b int, tag int, base long, a binary, row binary, n binary"


def packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "b", "tag", "base", "a", "row", "n"])


def posted(table: DataFrame, counts: DataFrame, width: int, plan: tuple[np.ndarray, np.ndarray], step: int = STEP) -> DataFrame:
    """Two kinds of rows for each partition and b id: tag 0 has the b id's counts, tag 1 a step's postings: a, place of the document behind
    ``base``, multiplicity."""
    sent = table.sparkSession.sparkContext.broadcast(plan)  # a number for each b id and group

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, begin = sent.value
        for batch in batches:
            numbers = batch.column("row").to_numpy()
            for own, lengths, keys, times in flat_lists(batch, "pairs", "times", step=step):
                if not len(keys):
                    continue
                rows, base = np.repeat(numbers[own], lengths), int(numbers[own[0]])
                g = group[keys // width]
                part = begin[g] + int(mix(np.uint64(base)) >> np.uint64(2)) % (begin[g + 1] - begin[g])  # a step's documents stay together
                order = np.lexsort((keys, part))
                keys, times, rows, part = keys[order], times[order], rows[order], part[order]
                b = keys // width
                at = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (part[1:] != part[:-1])))
                a, row, n = (keys % width).astype("<u4"), (rows - base).astype("<i8"), times.astype("<i8")
                if row.max(initial=0) < 1 << 31 and row.min(initial=0) >= 0:
                    row = row.astype("<u4")
                if n.max(initial=0) < 1 << 16:
                    n = n.astype("<u2")
                if width <= 1 << 16:
                    a = a.astype("<u2")
                ends = np.append(at[1:], len(b))
                out = [(p, x, 1, base, a[s:e].tobytes(), row[s:e].tobytes(), n[s:e].tobytes()) for p, x, s, e in zip(part[at].tolist(), b[at].tolist(), at.tolist(), ends.tolist(), strict=True)]
                for k in range(0, len(out), 4096):
                    yield packed(out[k : k + 4096])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, begin = sent.value
        for batch in batches:
            for b, a, n in zip(*[batch.column(c).to_pylist() for c in ("b", "a", "n")], strict=True):
                yield from (packed([(p, b, 0, 0, a, b"", n)]) for p in range(begin[group[b]], begin[group[b] + 1]))

    return table.select("row", "pairs", "times").mapInArrow(work, PACKED).union(counts.select("b", "a", "n").mapInArrow(spread, PACKED))


def contributions(posts: DataFrame, width: int, flush: int = 1 << 20) -> DataFrame:
    """row, n_best, count_sum: what a partition's b ids add to documents; rows come sorted by part, b and tag."""

    def numbers(raw: bytes, n: int) -> np.ndarray:
        return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, used, top, key = np.zeros(width, np.int64), np.zeros(0, np.int64), 0, None
        rows, best, total, waiting = [], [], [], 0

        def out() -> pa.RecordBatch:
            own, back = np.unique(np.concatenate(rows), return_inverse=True)
            sums = [np.zeros(len(own), np.int64) for _ in range(2)]
            np.add.at(sums[0], back, np.concatenate(best))
            np.add.at(sums[1], back, np.concatenate(total))
            return pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, sums)], ["row", "n_best", "count_sum"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "b", "tag", "base", "a", "row", "n")]
            for part, b, tag, base, a, row, n in zip(*columns, strict=True):
                if tag == 0:  # the counts of a b id, before all of its postings here
                    count[used] = 0
                    used, own, key = np.frombuffer(a, "<u4"), np.frombuffer(n, "<i8"), (part, b)
                    count[used], top = own, int(own.max())
                    continue
                if key != (part, b):
                    raise ValueError("postings without counts")
                many = len(a) // (2 if width <= 1 << 16 else 4)
                ids, times = numbers(a, many), numbers(n, many)
                own = count[ids]
                rows.append(numbers(row, many) + base)
                best.append(np.where(own == top, times, 0))
                total.append(own * times)
                waiting += many
                if waiting > flush:
                    yield out()
                    rows, best, total, waiting = [], [], [], 0
        if rows:
            yield out()

    return posts.mapInArrow(work, "row long, n_best long, count_sum long")


def alignment(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B, share: int = SHARE, step: int = STEP) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``.

    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros and ''. Repeated rows
    and ids count each for itself; a null doc_id stays null; other columns are ignored; an empty table gives no rows."""
    table = tokenized(docs, model_a, model_b)
    width = _width(model_a)
    counts = counted(table, width)
    plan = dealt(counts, share)
    posts = posted(table, counts, width, plan, step).repartitionById(int(plan[1][-1]), F.col("part")).sortWithinPartitions("part", "b", "tag")
    sums = contributions(posts, width).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    return table.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
