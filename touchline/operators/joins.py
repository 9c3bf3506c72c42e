"""Unification: dedup, keys, lookups, upserts, validation, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Source priorities (smaller wins) and offsets of surrogate ids.
PRIORITY = {"FD": 0, "XG": 1, "FB": 1, "SB": 1, "US": 2, "HF": 3, "OF": 4, "TS": 4}
OFFSETS = {"FD": 1, "HF": 1_000_000, "TS": 2_000_000, "OF": 3_000_000, "FB": 5_000_000, "XG": 6_000_000, "SB": 7_000_000, "US": 8_000_000}


def unify(frames: list[DataFrame], min_year: int | None = None) -> DataFrame:
    """Union by name with missing columns null; rows without date, teams or scores go."""
    made = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    made = made.dropna(subset=["date", "home_team", "away_team", "home_goals", "away_goals"])
    return made.where(F.year("date") >= min_year) if min_year else made


def dedup_by_priority(df: DataFrame, values: list[str], xg: str | None = None) -> DataFrame:
    """One row per day and (lower, trimmed) teams: best source, then most complete (``xg`` counts two more), then match_id."""
    rank = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    filled = sum((F.col(c).isNotNull().cast("int") for c in values), F.lit(0)) + (2 * F.col(xg).isNotNull().cast("int") if xg else F.lit(0))
    key = [F.to_date("date"), F.lower(F.trim("home_team")), F.lower(F.trim("away_team"))]
    w = W.partitionBy(*key).orderBy(F.coalesce(rank[F.col("source")], F.lit(9)), filled.desc(), "match_id")
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in an explicit order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def surrogate_ids(df: DataFrame, group: str, name: str, source: str) -> DataFrame:
    """Ids by group and name order plus the source's offset. Names are ranked inside their group; group offsets are running
    sums over one row a group, so no window holds all rows."""
    names = df.select(group, name).distinct()
    per = names.groupBy(group).agg(F.count("*").alias("_n"))
    before = per.select(group, (F.sum("_n").over(W.orderBy(group)) - F.col("_n")).alias("_before"))
    ranked = names.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(name))).join(before, group)
    ids = ranked.select(group, name, (F.lit(OFFSETS[source]) + F.col("_before") + F.col("_r") - 1).alias("team_id"))
    return df.join(ids, [group, name])


def results_near(requests: DataFrame, results: DataFrame, days: int = 7) -> DataFrame:
    """For each request (request_id, home, away, day) the best result of either orientation within ``days``: source priority,
    then nearest.

    Of a pair's results of one day only the best can win, and requests of a pair's day have one answer. So days are joined, not
    rows: an equi-join on the pair and the bucket of ``days`` days, of which a bucket holds ``days`` at most on either side."""
    since = lambda c: F.datediff(c, F.lit("1970-01-01"))
    swapped = results.select(F.col("away").alias("home"), F.col("home").alias("away"), "day", F.col("away_goals").alias("home_goals"), F.col("home_goals").alias("away_goals"), "priority", F.lit(True).alias("swapped"))
    both = results.select("home", "away", "day", "home_goals", "away_goals", "priority", F.lit(False).alias("swapped")).union(swapped)
    rest = ("swapped", "result_day", "home_goals", "away_goals")
    known = both.withColumnRenamed("day", "result_day").groupBy("home", "away", since("result_day").alias("_r")).agg(F.min(F.struct("priority", *rest)).alias("_best"))
    known = known.withColumn("bucket", F.floor(F.col("_r") / days))
    asked = requests.select("home", "away", since("day").alias("_d")).distinct().withColumn("bucket", F.explode(F.array(*[F.floor(F.col("_d") / days) + k for k in (-1, 0, 1)])))
    gap = F.abs(F.col("_d") - F.col("_r"))
    found = asked.join(known, ["home", "away", "bucket"]).where(gap <= days)
    answers = found.groupBy("home", "away", "_d").agg(F.min(F.struct(F.col("_best.priority").alias("priority"), gap.alias("gap"), *[F.col(f"_best.{c}").alias(c) for c in rest])).alias("_best"))
    made = requests.withColumn("_d", since("day")).join(answers, ["home", "away", "_d"])
    made = made.select("home", "away", *[c for c in requests.columns if c not in ("home", "away")], "_best")
    return keep(made, ["request_id"], [F.col("_best")]).select("*", *[F.col(f"_best.{c}").alias(c) for c in ("result_day", "home_goals", "away_goals", "priority", "swapped")]).drop("_best")


def enrich(df: DataFrame, update: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Cells that are null or 0 take the update's non-zero values."""
    new = keep(update, keys, [F.col(c) for c in columns]).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    made = df.join(new, keys, "left")
    return made.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.nullif(F.col(f"_new_{c}"), F.lit(0)), F.col(c)) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest new row per key (by ``order``) over the old one; empty and null cells keep the old value."""
    values = [c for c in old.columns if c not in keys]
    last = keep(new, keys, [F.col(order).desc(), *[F.col(c) for c in values]]).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    cell = lambda c: F.coalesce(F.nullif(F.col(f"_new_{c}"), F.lit("")) if dict(old.dtypes)[c] == "string" else F.col(f"_new_{c}"), F.col(c)).alias(c)
    return old.join(last, keys, "full").select(*keys, *[cell(c) for c in values])


def validation_issues(df: DataFrame) -> DataFrame:
    """A row per broken rule: same_team, missing_kickoff, negative_goals, impossible_score (half time above full time)."""
    rule = lambda name, cond: F.when(cond, F.lit(name))
    rules = F.array(
        rule("same_team", F.col("home_team_id") == F.col("away_team_id")),
        rule("missing_kickoff", F.col("date").isNull()),
        rule("negative_goals", (F.col("home_goals") < 0) | (F.col("away_goals") < 0)),
        rule("impossible_score", (F.col("ht_home_goals") > F.col("home_goals")) | (F.col("ht_away_goals") > F.col("away_goals"))),
        rule("missing_team_name", F.coalesce("home_team", F.lit("")) == ""),
    )
    return df.select("match_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("issue"))


def issue_log(issues: DataFrame, message: Column) -> DataFrame:
    return issues.withColumn("message", F.substring(message, 1, 2000))


def search_names(names: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Ranked name search (a top-k report): prefix, contained, initials; one row per lower-cased name."""
    n, q = F.lower(F.trim("name")), query.lower()
    initials = F.array_join(F.transform(F.split(n, r"\s+"), lambda x: F.substring(x, 1, 1)), "")
    score = F.when(n.startswith(q), 100).when(n.contains(q), 60).when(initials.startswith(q), 40).otherwise(0)
    made = names.withColumns({"key": n, "score": score}).where("score > 0").groupBy("key").agg(F.max("score").alias("score"), F.max("popularity").alias("popularity"))
    return made.orderBy(F.desc("score"), F.desc("popularity"), "key").limit(limit)


def char_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct letters of two names."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda v: v != "")) for c in (a, b))
    return F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0))
