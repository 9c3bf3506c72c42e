"""Live prediction and snapshots; the same expressions serve batch replay and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pre-match snapshot labels and their hours before kickoff.
OFFSETS = {"T-48H": 48, "T-24H": 24, "T-12H": 12, "T-6H": 6, "T-3H": 3, "T-1H": 1, "T-30M": 0.5, "T-10M": 1 / 6, "KO": 0}


def live_rates(minute: Column, pre_home: Column, pre_away: Column, xg_home: Column, xg_away: Column) -> tuple[Column, Column]:
    """Full-match rates: what was created so far (by default the expected share) and the rest of the match at pre-match pace."""
    gone = F.greatest(F.lit(0.0), F.least(F.lit(120.0), minute.cast("double")))
    rest = F.greatest(F.lit(0.0), (90 - gone) / 90)
    done = F.least(gone / 90, F.lit(1.0))
    return F.coalesce(xg_home, pre_home * done) + pre_home * rest, F.coalesce(xg_away, pre_away * done) + pre_away * rest


def snapshot_schedule(fixtures: DataFrame) -> DataFrame:
    """Nine snapshot times per fixture."""
    items = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(int(v * 60)).alias("minutes")) for k, v in OFFSETS.items()])
    made = fixtures.select("match_id", "date", F.explode(items).alias("s"))
    return made.select("match_id", F.col("s.label").alias("label"), F.concat(F.col("match_id").cast("string"), F.lit("_"), F.col("s.label")).alias("snapshot_id"), (F.col("date") - F.make_dt_interval(F.lit(0), F.lit(0), F.col("s.minutes"))).alias("at"))


def stability(snapshots: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Mean L1 change between a key's consecutive predictions."""
    w = W.partitionBy(key).orderBy(*order)
    change = sum((F.abs(F.col(f"p_{x}") - F.lag(f"p_{x}").over(w)) for x in "hda"), F.lit(0.0))
    return snapshots.withColumn("_c", change).groupBy(key).agg(F.round(F.avg("_c"), 6).alias("stability"), F.count("*").alias("n"))
