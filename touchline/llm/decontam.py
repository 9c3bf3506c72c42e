"""Operator 8: benchmark decontamination with DataFrame functions only.

Benchmark items give windows of consecutive words, whose hashes are broadcast: a benchmark is small, and its size in bytes is
checked. Every word position of a document probes the set with the hash of the words from there on; positions that hit are
compared with the window's words. Beyond the broadcast's bound the join shuffles hashes and places, no texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: Bytes of all windows' words up to which they are broadcast, and bytes of a row beside them.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 96
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEY = ["id_part", "text_part"]


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of letters, digits and non-ASCII characters; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def keyed(docs: DataFrame) -> list[Column]:
    """A row's key: doc_id (null as 0) and a hash of doc_id and text, so rows of one doc_id with two texts stay apart."""
    known = F.col("doc_id").cast("long")
    return [F.coalesce(known, F.lit(0)).alias(KEY[0]), F.xxhash64(known, "text").alias(KEY[1])]


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """window (its words), k (their number) and items (ids as strings) of every window; an item of fewer words is one window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))).alias("at")
    made = items.select("item_id", "w", at).select("item_id", F.slice("w", F.col("at"), size).alias("window"))
    return made.groupBy("window").agg(F.collect_set("item_id").alias("items")).withColumn("k", F.size("window"))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame | None:
    """KEY, at (0-based word), k, items of every occurrence of a window; None without any window. docs has KEY and w."""
    wins = windows(benchmark, size)
    sizes = wins.groupBy("k").agg(F.sum(F.length(F.array_join("window", " ")) + F.size("items") * 16 + ROW_BYTES).alias("bytes")).collect()  # ``size`` rows at most
    kinds = sorted(r["k"] for r in sizes)
    if not kinds:
        return None
    small = sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES
    anchor = lambda word, k: F.xxhash64(F.lit(k), *[word(i) for i in range(k)])
    known = None
    for k in kinds:
        part = wins.where(F.col("k") == k).select("k", anchor(lambda i: F.xxhash64(F.get("window", F.lit(i))), k).alias("anchor"), "window", "items")
        known = part if known is None else known.union(part)
    # words are hashed once; each position then takes the hashes from there on, and those too near the end fit no window.
    # The outer explode keeps the optimiser from splitting each text once more to find the empty ones.
    hashed = docs.select(*KEY, *(["w"] if small else []), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    placed = hashed.select(*hashed.columns, F.posexplode_outer("h").alias("at", "first"))
    probes = [F.struct(F.lit(k).alias("k"), anchor(lambda i: F.col("first") if i == 0 else F.get("h", F.col("at") + i), k).alias("anchor")) for k in kinds]
    if len(kinds) == 1:
        probe = placed.select(*KEY, *(["w"] if small else []), "at", probes[0].alias("p"))
    else:
        probe = placed.select(*KEY, *(["w"] if small else []), "at", F.explode(F.array(*probes)).alias("p"))
    probe = probe.select(*KEY, *(["w"] if small else []), "at", "p.k", "p.anchor")
    same = F.slice("w", F.col("at") + 1, F.size("window")) == F.col("window")  # of both sides, so no key of the join: only hits pay for it
    if small:
        found = probe.join(F.broadcast(known), ["k", "anchor"])
    else:
        found = probe.join(known, ["k", "anchor"]).join(docs.dropDuplicates(KEY), KEY)
    return found.where(same).select(*KEY, "at", "k", "items")


def scanned(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame | None:
    """KEY, hit_at (places, sorted) and items (sorted as strings) of the documents with a hit; None without any window.
    Rows that repeat count once."""
    found = hits(docs, benchmark, size)
    if found is None:
        return None
    cover = found.groupBy(*KEY, "at").agg(F.max("k").alias("k"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # a document's hits are at most its words, its items at most the benchmark's
    return cover.groupBy(*KEY).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("k") - 1))))).alias("hit_at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words. Every row gives one result, whatever its doc_id (null or repeated). Benchmark items
    without words have no window; an empty benchmark hits nothing; an empty table gives an empty result. Texts of any length
    are scanned whole. Other columns are ignored.
    """
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keyed(docs), words(F.col("text")).alias("w"))
    found = scanned(made.select(*KEY, "w"), benchmark, size)
    base = made.select("doc_id", *KEY, F.size("w").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    if found is None:
        base = base.withColumns({"hit_at": F.array().cast("array<int>"), "items": none})
    else:
        base = base.join(found, KEY, "left")
    n_hit = F.size(F.coalesce("hit_at", F.array().cast("array<int>"))).cast("long")
    named = F.coalesce("items", none)
    return base.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(named).cast("long").alias("n_items"), F.sha2(F.array_join(named, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, drop: bool = False, drop_share: float = 1.0) -> DataFrame:
    """``docs`` without the hit words, or without the documents (``drop``, or a hit share of ``drop_share`` or more).

    Only documents with a hit are rebuilt, as their words and the characters between them with the hit words and
    the gaps before them taken out; null, empty and clean texts stay as they are, of any length. Columns of docs stay,
    whatever their names. Rows that repeat, or share a doc_id, are judged each by its own text. An empty table or an empty
    benchmark changes nothing.
    """
    row = docs.select(*keyed(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("own"))
    found = scanned(row.select(*KEY, words(F.col("own")).alias("w")), benchmark, size)
    if found is None:
        return docs
    joined = row.join(found.select(*KEY, "hit_at"), KEY, "left")
    # (gap, word) tokens in order; the last one is the gap behind the last word
    tokens = F.regexp_extract_all("own", F.lit(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), 0)
    gone = F.filter(tokens, lambda x, i: ~F.array_contains("hit_at", i))
    rebuilt = F.when(F.col("hit_at").isNull(), F.col("own")).otherwise(F.ltrim(F.array_join(gone, "")))
    bad = F.col("hit_at").isNotNull() & (F.lit(drop) | (F.size("hit_at") >= F.size(words(F.col("own"))) * drop_share))
    return joined.where(~bad).select(*[rebuilt.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
