"""Names of entities matched across sources. Every join goes by keys that a matching pair must share (the rarest run of letters of the
name within, the rarer words, the rarer pairs of letters), so none is lost and common words are no keys."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.joins import char_jaccard

#: Small letters with marks (and the capital dotted I) and what they are written as.
MARKED, PLAIN = "çğıöşüâîûéàèùäëïİ", "cgiosuaiueaeuaeii"

#: Abbreviations for a club that may stand before or behind its name.
BEFORE = ["fc", "sc", "sv", "bv", "vfl", "vfb", "fk", "afc", "cf", "if", "bk", "gf", "hk"]
BEHIND = ["fc", "sk", "bv", "sv", "sc", "ac", "as", "ssv", "vfl", "vfb", "fk", "afc", "cf", "if", "bk", "gf", "hk"]


def plain_letters(name: Column) -> Column:
    """Lower-case with marks taken off."""
    return F.translate(F.lower(F.replace(name, F.lit("İ"), F.lit("I"))), MARKED, PLAIN)


def normalised_name(name: Column) -> Column:
    """Lower-case, marks taken off, white space single. No word is dropped: it may tell two teams of a town apart."""
    return F.trim(F.regexp_replace(plain_letters(name), r"\s+", " "))


def club_name(name: Column) -> Column:
    """The normalised name without an abbreviation before it, and without one behind it if a word is left."""
    n = F.regexp_replace(F.trim(plain_letters(name)), rf"^({'|'.join(BEFORE)})\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(n, r"\s+", " "), rf"(?<=\S) ({'|'.join(BEHIND)})$", ""))


@F.pandas_udf(T.DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in matching blocks (the longest first, then to its left and right) over the letters of both names."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _words(n: Column) -> Column:
    return F.array_distinct(F.filter(F.split(n, " "), lambda w: F.length(w) > 3))


def name_similarity(a: Column, b: Column, otherwise: Column | None = None) -> Column:
    """1 for equal normalised names, 0.95 if one of over five letters is within the other, 0.85 to 0.95 for enough shared words of four
    letters or more, else ``otherwise`` (the block ratio), 0.80 at most, or 0 without one."""
    x, y = _words(a), _words(b)
    common = F.size(F.array_intersect(x, y))
    enough = (common > 0) & (common >= F.least(F.lit(2), F.least(F.size(x), F.size(y))))
    within = (b.contains(a) & (F.length(a) > 5)) | (a.contains(b) & (F.length(b) > 5))
    rest = F.least(F.lit(0.80), otherwise) if otherwise is not None else F.lit(0.0)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(within, 0.95).when(enough, 0.85 + 0.10 * common / F.greatest(F.size(x), F.size(y))).otherwise(rest)


def _grams(n: Column, k: Column | int) -> Column:
    """All runs of k letters of a name that has as many, in order."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(F.length(n) >= k, F.transform(F.sequence(F.lit(1), F.length(n) - k + 1), lambda i: F.substr(n, i, k))).otherwise(F.array().cast("array<string>"))


def contained_pairs(inner: DataFrame, outer: DataFrame, least: int = 6, run: int = 6) -> DataFrame:
    """a, b: every name of ``inner`` (a) of ``least`` letters or more that is within a name of ``outer`` (b).

    A name within another has all its runs of ``run`` letters there (a shorter one is a run itself), so it is looked up by the one that
    fewest outer names hold; a name with a run that no outer name holds is out at once. Both tables hold distinct names."""
    sizes = range(min(least, run), run + 1)
    keys = outer.select("b", F.explode(F.array_distinct(F.concat(*[_grams(F.col("b"), k) for k in sizes]))).alias("_g"))
    often = keys.groupBy("_g").agg(F.count("*").alias("_n"))
    asked = inner.where(F.length("a") >= least).withColumn("_own", F.array_distinct(_grams(F.col("a"), F.least(F.length("a"), F.lit(run)))))
    held = asked.select("a", F.size("_own").alias("_all"), F.explode("_own").alias("_g")).join(often, "_g")
    rarest = held.groupBy("a", "_all").agg(F.min(F.struct("_n", "_g"))["_g"].alias("_g"), F.count("*").alias("_found")).where("_found = _all")
    return rarest.join(keys, "_g").where(F.col("b").contains(F.col("a"))).select("a", "b")


def word_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b: every pair of names that shares two words of four letters or more, or one where a name has only one.

    Names of two words or more meet by all their words but the most common one: a pair that shares two shares one of those. A name
    of one word meets all names with it. Both tables hold distinct names."""
    both = left.select(F.col("a").alias("n")).union(right.select(F.col("b").alias("n"))).select(F.explode(_words(F.col("n"))).alias("_w"))
    often = both.groupBy("_w").agg(F.count("*").alias("_n"))

    def placed(df: DataFrame, c: str) -> DataFrame:
        own = df.select(c, F.explode(_words(F.col(c))).alias("_w")).join(often, "_w").groupBy(c).agg(F.array_sort(F.collect_list(F.struct("_n", "_w"))).alias("_s"))
        return own.select(c, F.transform("_s", lambda x: x["_w"]).alias("_s"), F.size("_s").alias("_k"))

    a, b = placed(left, "a"), placed(right, "b")
    many = lambda df, c: df.where("_k > 1").select(c, F.explode(F.slice("_s", F.lit(1), F.col("_k") - 1)).alias("_w"))
    each = lambda df, c, cond: df.where(cond).select(c, F.explode("_s").alias("_w"))
    met = [many(a, "a").join(many(b, "b"), "_w"), each(a, "a", "_k = 1").join(each(b, "b", "_k >= 1"), "_w"), each(a, "a", "_k > 1").join(each(b, "b", "_k = 1"), "_w")]
    pairs = reduce(DataFrame.unionByName, [x.select("a", "b") for x in met]).distinct()
    x, y = _words(F.col("a")), _words(F.col("b"))
    return pairs.where(F.size(F.array_intersect(x, y)) >= F.least(F.lit(2), F.least(F.size(x), F.size(y))))


def _tokens(n: Column, k: int) -> Column:
    """Runs of k letters, each with its number among the equal ones, so that a set of them counts like a bag."""
    own = _grams(n, k)
    return F.transform(own, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(own, 1, i + 1), lambda x: x == g)).cast("string")))


def ratio_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b: every pair of names whose block ratio may reach ``least``, filtered by length and by letters in common.

    With L letters in both, a ratio r means r L / 2 letters in blocks. Blocks are parted by other letters, so there are no more than
    L - r L + 1, and (1.5 r - 1) L - 1 pairs of letters lie within them: names share so many, and one of their rarer ones (prefix filter).
    Where that is less than one, for r of 2/3 or less or very short names, single letters take the place of pairs; they tell little
    apart, so a low ``least`` is for a stated set of queries. Both tables hold distinct names."""
    shortest = lambda n: F.ceil(F.length(n) * least / (2 - least) - 1e-9)
    pairs_need = lambda n: F.ceil((1.5 * least - 1) * (F.length(n) + shortest(n)) - 1 - 1e-9)
    letters_need = lambda n: F.greatest(F.ceil(least / 2 * (F.length(n) + shortest(n)) - 1e-9), F.lit(1))

    def met(k: int, need, a: DataFrame, b: DataFrame) -> DataFrame:
        own = [df.select(c, F.explode(_tokens(F.col(c), k)).alias("_t")) for df, c in ((a, "a"), (b, "b"))]
        often = own[0].select("_t").union(own[1].select("_t")).groupBy("_t").agg(F.count("*").alias("_n"))
        keys = []
        for df, c in zip(own, "ab", strict=True):
            held = df.join(often, "_t").groupBy(c).agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("_s"))
            keys.append(held.select(c, F.explode(F.slice("_s", F.lit(1), F.greatest(F.size("_s") - need(F.col(c)) + 1, F.lit(0)).cast("int"))).alias("_x")).select(c, F.col("_x._t").alias("_t")))
        fits = (2 * F.least(F.length("a"), F.length("b")) >= least * (F.length("a") + F.length("b")) - 1e-9)
        return keys[0].join(keys[1], "_t").where(fits).select("a", "b").distinct()

    a, b = left.where("a <> ''"), right.where("b <> ''")
    if 1.5 * least - 1 > 0:
        wide = lambda c: pairs_need(F.col(c)) >= 1
        made = met(2, pairs_need, a.where(wide("a")), b.where(wide("b")))
        made = made.union(met(1, letters_need, a.where(~wide("a")), b)).union(met(1, letters_need, a.where(wide("a")), b.where(~wide("b"))))
    else:
        made = met(1, letters_need, a, b)
    common = F.size(F.array_intersect(_tokens(F.col("a"), 1), _tokens(F.col("b"), 1)))
    return made.where(2 * common >= least * (F.length("a") + F.length("b")) - 1e-9)


def match_names(queries: DataFrame, known: DataFrame, threshold: float = 0.85, overrides: DataFrame | None = None) -> DataFrame:
    """query_id, team_id and score of the best known name (team_id, name) for each query (query_id, name) of ``threshold`` or more; ties
    go to the smallest team_id. ``overrides`` (name, team_id) come first, with score 1. Null and empty names match nothing.

    Every pair that reaches the threshold is compared: equal names, names within names, shared words, and at 0.80 or less the block ratio."""
    q = queries.select("query_id", normalised_name(F.col("name")).alias("a")).where("a <> ''")
    k = known.select("team_id", normalised_name(F.col("name")).alias("b")).where("b <> ''")
    left, right = q.select("a").distinct(), k.select("b").distinct()
    swap = lambda df: df.select(F.col("b").alias("a"), F.col("a").alias("b"))
    found = [left.join(right, F.col("a") == F.col("b")), contained_pairs(left, right), swap(contained_pairs(swap_names(right), swap_names(left))), word_pairs(left, right)]
    if threshold <= 0.80:
        found.append(ratio_pairs(left, right, threshold))
    pairs = reduce(DataFrame.unionByName, found).distinct()
    score = name_similarity(F.col("a"), F.col("b"), block_ratio("a", "b") if threshold <= 0.80 else None)
    ids = k.groupBy("b").agg(F.min("team_id").alias("team_id"))
    scored = _best(pairs.withColumn("score", score).where(F.col("score") >= threshold).join(ids, "b"), "a").join(q, "a").select("query_id", "team_id", "score")
    if overrides is not None:
        fixed = overrides.select(normalised_name(F.col("name")).alias("a"), F.col("team_id"))
        scored = scored.union(q.join(fixed, "a").select("query_id", "team_id", F.lit(2.0).alias("score")))
    return _best(scored, "query_id").withColumn("score", F.least("score", F.lit(1.0)))


def _best(scored: DataFrame, key: str) -> DataFrame:
    """The team_id of the largest score for each key, the smallest on ties, and the score."""
    return scored.groupBy(key).agg(F.max_by("team_id", F.struct("score", -F.col("team_id"))).alias("team_id"), F.max("score").alias("score"))


def swap_names(df: DataFrame) -> DataFrame:
    """A table of names with its column named for the other side."""
    return df.withColumnRenamed(df.columns[0], "b" if df.columns[0] == "a" else "a")


def fuzzy_names(queries: DataFrame, known: DataFrame, threshold: float = 0.80) -> DataFrame:
    """query_id, team_id, score: the known club name of the largest block ratio with the query's, ``threshold`` or more; ties go to the
    smallest team_id. Abbreviations for a club count on neither side."""
    q = queries.select("query_id", club_name(F.col("name")).alias("a"))
    k = known.groupBy(club_name(F.col("name")).alias("b")).agg(F.min("team_id").alias("team_id"))
    pairs = ratio_pairs(q.select("a").distinct(), k.select("b"), threshold).withColumn("score", block_ratio("a", "b")).where(F.col("score") >= threshold)
    return _best(pairs.join(k, "b"), "a").join(q, "a").select("query_id", "team_id", "score")


def close_names(queries: DataFrame, known: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """query_id, team_id, how: an equal name; else the name of the largest block ratio from ``cutoff`` on (ties: the last in the
    alphabet); else one within the other (the smallest team_id). Names are lower-cased and trimmed; of one name's ids the largest counts."""
    q = queries.select("query_id", F.trim(F.lower("name")).alias("a"))
    k = known.groupBy(F.lower("name").alias("b")).agg(F.max("team_id").alias("team_id"))
    equal = q.join(k, F.col("a") == F.col("b")).select("query_id", "team_id", F.lit("equal").alias("how"))
    rest = q.join(equal.select("query_id"), "query_id", "left_anti")
    left, right = rest.select("a").distinct(), k.select("b")
    near = ratio_pairs(left, right, cutoff).withColumn("_r", block_ratio("b", "a")).where(F.col("_r") >= cutoff)
    close = near.groupBy("a").agg(F.max_by("b", F.struct("_r", "b")).alias("b")).join(rest, "a").join(k, "b").select("query_id", "team_id", F.lit("close").alias("how"))
    left = left.join(near.select("a").distinct(), "a", "left_anti")
    within = contained_pairs(left, right, 1).unionByName(contained_pairs(swap_names(right), swap_names(left), 1).select(F.col("b").alias("a"), F.col("a").alias("b")))
    inside = within.join(k, "b").groupBy("a").agg(F.min("team_id").alias("team_id")).join(rest, "a").select("query_id", "team_id", F.lit("within").alias("how"))
    return equal.union(close).union(inside)


def letter_tiers(a: Column, b: Column) -> Column:
    """100 for equal names, 90 if one is within the other, 80 to 95 by shared letters from 0.8 on, 60 or more from 0.6 on, up to 70 below."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    j = char_jaccard(x, y)
    return F.when(x == y, 100.0).when(x.contains(y) | y.contains(x), 90.0).when(j >= 0.8, 80 + 15 * j).when(j >= 0.6, 60 + 20 * j).otherwise(70 * F.coalesce(j, F.lit(0.0)))


def cached_results(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """For each request (request_id, home, away) a cached result (home, away, day, home_goals, away_goals) whose both names agree
    (equal, one within the other, or two shared words of four letters, one if the request's name has only one), on either side; goals
    are turned round with the sides. The newest day wins. Home names meet by what they must share, so no pair is lost."""
    q = requests.select("request_id", normalised_name(F.col("home")).alias("qh"), normalised_name(F.col("away")).alias("qa")).where("qh <> '' and qa <> ''")
    c = cache.select(normalised_name(F.col("home")).alias("ch"), normalised_name(F.col("away")).alias("ca"), "day", F.col("home_goals").alias("hg"), F.col("away_goals").alias("ag"), F.lit(False).alias("swapped")).where("ch <> '' and ca <> ''")
    both = c.union(c.select(F.col("ca"), F.col("ch"), "day", F.col("ag"), F.col("hg"), F.lit(True)))
    left, right = q.select(F.col("qh").alias("a")).distinct(), both.select(F.col("ch").alias("b")).distinct()
    back = contained_pairs(swap_names(right), swap_names(left), 1).select(F.col("b").alias("a"), F.col("a").alias("b"))
    names = contained_pairs(left, right, 1).unionByName(back).unionByName(word_pairs(left, right)).distinct()

    def agree(a: Column, b: Column) -> Column:
        common = F.size(F.array_intersect(_words(a), _words(b)))
        return (a == b) | a.contains(b) | b.contains(a) | ((common > 0) & (common >= F.least(F.lit(2), F.size(_words(a)))))

    found = q.join(names, F.col("qh") == F.col("a")).join(both, F.col("b") == F.col("ch")).where(agree(F.col("qh"), F.col("ch")) & agree(F.col("qa"), F.col("ca")))
    w = W.partitionBy("request_id").orderBy(F.desc("day"), "swapped", "hg", "ag", "ch", "ca")
    return found.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("request_id", "hg", "ag", "swapped")


def merged_entities(entities: DataFrame) -> DataFrame:
    """One row for each (normalised name, country): the id and name with most matches (the smallest id on ties) and the largest rating."""
    key = normalised_name(F.col("name"))
    best = F.struct("matches", -F.col("id"))
    return entities.groupBy(key.alias("key"), "country").agg(F.max_by("id", best).alias("id"), F.max_by("name", best).alias("name"), F.sum("matches").alias("matches"), F.max("rating").alias("rating"))


def resolved_names(ids: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Names of ids by two small lookups (id, name), the first before the second, else "Team" and the id."""
    a, b = first.select("id", F.col("name").alias("_a")), second.select("id", F.col("name").alias("_b"))
    return ids.join(a, "id", "left").join(b, "id", "left").select(*ids.columns, F.coalesce("_a", "_b", F.concat(F.lit("Team "), F.col("id").cast("string"))).alias("name"))


def sides_filled(matches: DataFrame, shots: DataFrame) -> DataFrame:
    """Null shots on target of both sides from expected goals (match_id, is_home, xg), rounded half to even as published."""
    of = lambda side: F.max(F.when(F.col("is_home") == side, F.col("xg")))
    per = shots.groupBy("match_id").agg(of(1).alias("_h"), of(0).alias("_a"))
    return matches.join(per, "match_id", "left").withColumns({"home_sot": F.coalesce("home_sot", F.bround("_h").cast("int")), "away_sot": F.coalesce("away_sot", F.bround("_a").cast("int"))}).drop("_h", "_a")
