"""Operator 4: near-duplicate groups by SetSketch registers.

Each text's set of word shingles gets m registers, the exponentially spaced (base b) and truncated
logarithms of minima of exponential variables; equal sets have equal registers and a union's
registers are the larger of the two. Registers are banded; members of a bucket are compared with its smallest member and
one chosen by hash, then, where components stay apart, with its most linked one, so a bucket of g texts gives fewer than
3 g pairs. Pairs are estimated by the joint likelihood of the two sketches, and those within reach of the threshold are
confirmed on full sets. What stars cannot settle, pairs across components in one bucket, goes through an exact prefix filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.common import STEP_BYTES, lowered, mix, run_hashes, runs, slices, texts_of, written


@dataclass(frozen=True)
class Plan:
    """Shingle length in words, similarity in hundredths, and the sketch's bands, rows a band, base and rate.

    With 40 bands of 5 registers a pair at similarity 0.8 goes unseen once in 8 million, at 0.85 far less.
    """

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    margin: float = 0.12  # by which an estimate may fall short: over four standard deviations of 200 registers

    @property
    def registers(self) -> int:
        return self.bands * self.rows


#: Partners of a text that one copy of it is compared with.
MEMBERS = 256
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each distinct shingle of each text, sorted by both.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a text of fewer words is one shingle.
    """
    data = lowered(data)
    starts, ends, row = runs((data != 32) & ((data < 9) | (data > 13)), offsets)
    value = run_hashes(data, starts, ends)
    if not len(value):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        made = np.zeros(len(value), np.uint64)
        last = np.searchsorted(row, row, side="right")
        left = last - np.arange(len(row))  # words from here to the text's end
        for k in range(words):
            at = np.minimum(np.arange(len(value)) + k, len(value) - 1)
            made = np.where(left > k, mix(made * _GOLD + value[at] + np.uint64(k + 1)), made)
        first = np.searchsorted(row, row, side="left") == np.arange(len(row))
    keep = (left >= words) | first  # a short text's first word starts its only shingle
    row, made = row[keep], made[keep]
    ends = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, len(row))
    for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
        made[a:b].sort()
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (made[1:] != made[:-1])
    return row[new], made[new]


def registers(row: np.ndarray, value: np.ndarray, n_rows: int, plan: Plan) -> np.ndarray:
    """The SetSketch registers of each row's set: n_rows by m, unsigned 16-bit.

    An element is a Poisson process of rate m whose points fall on random registers, so each register sees
    exponential variables. Points are made in rising order and only up to where a set's minima may lie.
    """
    m = plan.registers
    least = np.full(n_rows * m, np.inf)
    size = np.bincount(row, minlength=n_rows)
    limit = (np.log(m) + 3) / np.maximum(size, 1)
    state = mix(value + _GOLD)
    x, step = np.zeros(len(row)), np.uint64(0)

    def rise(at: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            state[at] = mix(state[at] + _GOLD)
        x[at] += -np.log((((state[at] >> np.uint64(12)).astype(np.float64)) + 0.5) / 2.0**52) / m

    rise(np.arange(len(row)))
    live = np.arange(len(row))
    while len(live):
        act = live[x[live] <= limit[row[live]]]
        while len(act):
            with np.errstate(over="ignore"):
                where = ((mix(state[act] ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            np.minimum.at(least, row[act] * m + where.astype(np.int64), x[act])
            rise(act)
            act = act[x[act] <= limit[row[act]]]
        short = np.isinf(least.reshape(n_rows, m)).any(axis=1) & (size > 0)
        limit[short] *= 1.5
        live = live[short[row[live]]]
    with np.errstate(divide="ignore"):
        level = np.floor(1 + (np.log(plan.rate) - np.log(least)) / np.log(plan.base))
    return np.clip(level, 0, 65535).astype("<u2").reshape(n_rows, m)


def likeliest(greater: np.ndarray, less: np.ndarray, m: int, n_a: np.ndarray, n_b: np.ndarray, base: float) -> np.ndarray:
    """The similarity that makes these counts of greater and smaller registers likeliest, by bisection on the slope."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    k, ln = (base - 1) / base, np.log(base)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * k) / ln

    for _ in range(40):
        j = (lo + hi) / 2
        a, b = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        da, db = -v * k / (1 - (u - v * j) * k) / ln, -u * k / (1 - (v - u * j) * k) / ln
        slope = greater * da / a + less * db / b - (m - greater - less) * (da + db) / np.maximum(1 - a - b, 1e-12)
        lo, hi = np.where(slope > 0, j, lo), np.where(slope > 0, hi, j)
    return (lo + hi) / 2


def sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n_shingles, two sums that tell equal sets, and the registers as bytes (null for an empty set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, limit=STEP_BYTES):
            row, value = shingles(data, offsets, plan.words)
            n = part.num_rows
            size = np.bincount(row, minlength=n)
            at = np.concatenate([[0], np.cumsum(size)])
            with np.errstate(over="ignore"):
                sums = [np.concatenate([[0], np.cumsum(x)]).astype(np.uint64) for x in (value, mix(value ^ _GOLD))]
                one, two = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
            made = registers(row, value, n, plan)
            raw = [made[k].tobytes() if size[k] else None for k in range(n)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(one), pa.array(two), pa.array(raw, pa.binary())], ["doc_id", "n_shingles", "one", "two", "registers"])

    return texts_of(docs).mapInArrow(work, "doc_id long, n_shingles long, one long, two long, registers binary")


def band_key(k: int, plan: Plan) -> Column:
    width = 2 * plan.rows
    return F.xxhash64(F.lit(k), F.substring("registers", 1 + width * k, width))


def estimated(pairs: DataFrame, sk: DataFrame, plan: Plan) -> DataFrame:
    """Those of the pairs (a, b) whose likeliest similarity may reach the threshold."""
    least = plan.percent / 100 - plan.margin

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("ra", "rb"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            like = likeliest((one > two).sum(axis=1), (one < two).sum(axis=1), plan.registers, n_a, n_b, plan.base)
            yield batch.select(["a", "b"]).filter(pa.array(like >= least))

    side = lambda x: sk.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * plan.percent
    return pairs.join(side("a"), "a").join(side("b"), "b").where(fits).mapInArrow(work, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets reach the threshold.

    A text a is sent once for MEMBERS of its partners b at most, which follow it as rows of a sorted partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for part, data, offsets in slices(batches, limit=STEP_BYTES):
            row, value = shingles(data, offsets, plan.words)
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            good = []
            for k, b in enumerate(part.column("b").to_pylist()):
                mine = value[ends[k] : ends[k + 1]]
                if b is None:
                    own = mine
                    good.append(False)
                    continue
                both = len(np.intersect1d(own, mine, assume_unique=True))
                good.append(100 * both >= plan.percent * (len(own) + len(mine) - both))
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    texts = docs.select(F.col("doc_id").alias("key"), "text")
    heads = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("key")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    members = dealt.join(texts, F.col("b") == F.col("key")).select("a", "part", "b", "text")
    return heads.union(members).repartition("a", "part").sortWithinPartitions("a", "part", "b").mapInArrow(work, "a long, b long")


def ranked(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, h, rank: each text's shingles that some other of ``docs`` has as well, ranked among all its own from rare to common."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, limit=STEP_BYTES):
            row, value = shingles(data, offsets, plan.words)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(value.view(np.int64))], ["doc_id", "h"])

    held = written(docs.mapInArrow(work, "doc_id long, h long"), "shingles")
    found = held.groupBy("h").agg(F.count("*").alias("df"), F.min("doc_id").alias("doc_id"))
    alone = found.where("df = 1").groupBy("doc_id").agg(F.count("*").alias("alone"))
    shared = held.join(found.where("df > 1").select("h", "df"), "h").join(alone, "doc_id", "left")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("df", "h"))  # one text's shingles
    return shared.select("doc_id", "h", (place + F.coalesce("alone", F.lit(0))).alias("rank"))


def ordered(pairs: DataFrame) -> DataFrame:
    """Each unordered pair of two different texts once, the smaller one as a."""
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hubs(buckets: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of each bucket's most linked member with the members of other components: a second star, no square."""
    degree = links.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("degree"))
    known = buckets.select("key", "doc_id").join(degree, "doc_id", "left").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    known = written(known.select("key", "doc_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("root", "doc_id").alias("root")), "known")
    best = F.struct("degree", F.xxhash64("key", "doc_id").alias("x"), "doc_id", "root")
    hub = known.groupBy("key").agg(F.max(best).alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    return ordered(known.join(hub, "key").where("root <> hub.root").select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")))


def undecided(buckets: DataFrame, roots: DataFrame, texts: DataFrame, sizes: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) that star comparison left open and that may reach the threshold.

    Open are two members of a bucket in different components, neither a centre of its stars. Members outside a bucket's most
    frequent component are looked up by prefix filtering, which is exact: ranked from rare to common, two sets that
    reach the threshold share one of their first shingles, and so near the front that enough can follow.
    """
    p = plan.percent
    known = buckets.where("doc_id not in (pivot, other)").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    per = known.groupBy("key", "root").agg(F.count("*").alias("n"))
    mains = per.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("key", "main")
    mixed = known.join(mains, "key").groupBy("doc_id").agg(F.first("root").alias("root"), F.max((F.col("root") != F.col("main")).cast("int")).alias("minor"))
    mixed = written(mixed.join(sizes, "doc_id"), "mixed")
    front = ranked(texts.join(mixed.select("doc_id"), "doc_id", "left_semi"), plan).join(mixed, "doc_id")
    front = written(front.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * p / 100) + 1), "front")
    short = F.col("rank") <= F.col("n") - F.ceil(F.col("n") * (2 * p) / (100 + p)) + 1  # enough for the smaller of two sets
    x = lambda df: df.select("h", *[F.col(c).alias(f"x_{c}") for c in ("doc_id", "root", "n", "rank")])
    y = lambda df: df.select("h", *[F.col(c).alias(f"y_{c}") for c in ("doc_id", "root", "n", "rank")])
    reach = (1 + F.least(F.col("x_n") - F.col("x_rank"), F.col("y_n") - F.col("y_rank"))) * (100 + p) >= (F.col("x_n") + F.col("y_n")) * p
    open_ = (F.col("x_root") != F.col("y_root")) & reach & (F.col("x_n") * 100 >= F.col("y_n") * p) & (F.col("x_n") <= F.col("y_n"))
    minor = F.col("minor") == 1
    pairs = x(front.where(minor & short)).join(y(front), "h").where(open_)
    pairs = pairs.union(x(front.where(short & ~minor)).join(y(front.where(minor)), "h").where(open_))
    return pairs.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) for every node of ``edges`` (a, b), by alternating stars.

    An iteration is two groupings and joins on edges; each is written to the shared folder. It takes about
    the logarithm of a component's diameter, here two to five iterations.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    last = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.where("u > v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Null, empty and all-white texts have no shingle, are linked with nothing and are kept. Texts with equal
    sets (equal in size and in two sums of 64-bit hashes, some 128 bits) form a class, whose smallest doc_id stands for all. doc_id identifies a row: rows that repeat a doc_id
    with one text are one document to the links and each gets its result. Other columns are ignored.
    """
    docs = texts_of(docs)
    sk = written(sketches(docs, plan), "sketches")
    some = sk.where("n_shingles > 0")
    classes = some.groupBy("n_shingles", "one", "two").agg(F.min("doc_id").alias("rep"))
    member = some.select("doc_id", "n_shingles", "one", "two").join(classes, ["n_shingles", "one", "two"]).select("doc_id", "n_shingles", "rep")
    reps = written(some.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "registers"), "reps")

    keys = reps.select("doc_id", F.explode(F.array(*[band_key(k, plan) for k in range(plan.bands)])).alias("key"))
    pick = F.min_by("doc_id", F.xxhash64("doc_id", "key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("pivot"), pick.alias("other"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = written(keys.join(shared, "key"), "buckets")
    # the texts that any comparison may ask for leave the corpus once
    asked = docs.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = written(asked.dropDuplicates(["doc_id"]), "texts")
    sizes = reps.select("doc_id", F.col("n_shingles").alias("n"))

    def linked(pairs: DataFrame) -> DataFrame:
        return written(confirmed(written(estimated(pairs, reps, plan), "estimates"), texts, plan), "links")

    links = linked(ordered(buckets.select(F.explode(F.array("pivot", "other")).alias("a"), F.col("doc_id").alias("b"))))
    links = links.union(linked(hubs(buckets, links, components(links))))
    roots = components(links)
    links = links.union(linked(undecided(buckets, roots, texts, sizes, plan)))
    roots = components(links)

    found = member.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    empty = sk.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(empty).withColumn("kept", F.col("doc_id") == F.col("component_id"))
