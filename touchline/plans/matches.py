"""Matches derived from the driver's tables: one plan in DataFrames and the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import table

SQL = """
WITH li AS (SELECT l_orderkey,
   sum(CASE WHEN l_returnflag='A' THEN 1 ELSE 0 END) hg, sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) ag,
   sum(CASE WHEN l_linenumber%2=0 THEN 1 ELSE 0 END) hc, sum(CASE WHEN l_linenumber%2=1 THEN 1 ELSE 0 END) ac
  FROM lineitem GROUP BY l_orderkey),
matches AS (SELECT o.o_orderkey match_id, n.n_regionkey league, year(o.o_orderdate) season, o.o_orderdate date,
  n.n_regionkey*100 + o.o_custkey%24 home_team_id,
  n.n_regionkey*100 + (o.o_custkey%24 + 1 + o.o_orderkey%23)%24 away_team_id,
  CAST(coalesce(hg,0) AS INT) home_goals, CAST(coalesce(ag,0) AS INT) away_goals,
  CAST(coalesce(hc,0) AS INT) home_corners, CAST(coalesce(ac,0) AS INT) away_corners,
  1.2 + (CAST(floor(o_totalprice) AS BIGINT) % 50) / 10.0e0 odds_h,
  2.5 + (CAST(floor(o_totalprice / 7) AS BIGINT) % 30) / 10.0e0 odds_d,
  1.3 + (CAST(floor(o_totalprice / 11) AS BIGINT) % 60) / 10.0e0 odds_a
 FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey JOIN nation n ON c.c_nationkey=n.n_nationkey
 LEFT JOIN li ON li.l_orderkey=o.o_orderkey),
preds AS (SELECT *, (1/(odds_h+0.3))/(1/(odds_h+0.3)+1/odds_d+1/(odds_a+0.1)) p_h, (1/odds_d)/(1/(odds_h+0.3)+1/odds_d+1/(odds_a+0.1)) p_d,
   (1/(odds_a+0.1))/(1/(odds_h+0.3)+1/odds_d+1/(odds_a+0.1)) p_a,
   CASE WHEN home_goals>away_goals THEN 'H' WHEN home_goals=away_goals THEN 'D' ELSE 'A' END result FROM matches),
long AS (SELECT match_id, league, season, date, home_team_id team, away_team_id opp, 1 is_home, home_goals gf, away_goals ga, home_corners cf FROM matches
  UNION ALL SELECT match_id, league, season, date, away_team_id, home_team_id, 0, away_goals, home_goals, away_corners FROM matches),
lp AS (SELECT *, CASE WHEN gf>ga THEN 3 WHEN gf=ga THEN 1 ELSE 0 END pts FROM long)
"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match per order; the line items are summed before the join, and only the columns used are read."""
    flag = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        flag(F.col("l_returnflag") == "A").alias("hg"), flag(F.col("l_returnflag") == "R").alias("ag"),
        flag(F.col("l_linenumber") % 2 == 0).alias("hc"), flag(F.col("l_linenumber") % 2 == 1).alias("ac"),
    )
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    base, home = F.col("n_regionkey") * 100, F.col("o_custkey") % 24
    goals = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("int")
    odds = lambda low, div, mod: low + (F.floor(F.col("o_totalprice") / div).cast("long") % mod) / F.lit(10.0)
    return joined.select(
        F.col("o_orderkey").alias("match_id"), F.col("n_regionkey").alias("league"), F.year("o_orderdate").alias("season"), F.col("o_orderdate").alias("date"),
        (base + home).alias("home_team_id"), (base + (home + 1 + F.col("o_orderkey") % 23) % 24).alias("away_team_id"),
        goals("hg").alias("home_goals"), goals("ag").alias("away_goals"), goals("hc").alias("home_corners"), goals("ac").alias("away_corners"),
        odds(1.2, 1, 50).alias("odds_h"), odds(2.5, 7, 30).alias("odds_d"), odds(1.3, 11, 60).alias("odds_a"),
    )


def predictions(df: DataFrame) -> DataFrame:
    """Matches with p_h, p_d, p_a (from shaded odds, normalised) and the result."""
    from touchline.functions import result_label

    h, d, a = 1 / (F.col("odds_h") + 0.3), 1 / F.col("odds_d"), 1 / (F.col("odds_a") + 0.1)
    total = h + d + a
    return df.withColumns({"p_h": h / total, "p_d": d / total, "p_a": a / total, "result": result_label(F.col("home_goals"), F.col("away_goals"))})
