"""Batch aggregates: tables, summaries, coverage, screens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _n(cond) -> F.Column:
    return F.sum(cond.cast("int")).cast("long")


def standings(long: DataFrame) -> DataFrame:
    """League tables per league and season, with the last-five form string (newest first)."""
    gf, ga, home = F.col("gf"), F.col("ga"), F.col("is_home") == 1
    rows = long.withColumn("rn", F.row_number().over(W.partitionBy("league", "season", "team").orderBy(F.desc("date"), F.desc("match_id"))))
    mark = F.when(gf > ga, "W").when(gf == ga, "D").otherwise("L")
    made = rows.groupBy("league", "season", "team").agg(
        F.count("*").alias("pl"), _n(gf > ga).alias("w"), _n(gf == ga).alias("d"), _n(gf < ga).alias("l"),
        F.sum("gf").cast("long").alias("gf"), F.sum("ga").cast("long").alias("ga"), F.sum(gf - ga).cast("long").alias("gd"), F.sum("pts").cast("long").alias("pts"),
        _n(home & (gf > ga)).alias("home_w"), _n(~home & (gf > ga)).alias("away_w"), _n(~home & (gf < ga)).alias("away_l"),
        _n((gf > 0) & (ga > 0)).alias("btts"), _n(gf + ga > 2).alias("over25"), _n(ga == 0).alias("clean"), _n(gf == 0).alias("blank"),
        F.array_sort(F.collect_list(F.when(F.col("rn") <= 5, F.struct("rn", mark.alias("m"))))).alias("last"),
    )
    made = made.withColumn("form5", F.array_join(F.transform("last", lambda x: x["m"]), "")).drop("last")
    w = W.partitionBy("league", "season").orderBy(F.desc("pts"), F.desc("gd"), F.desc("gf"), "team")
    return made.withColumn("pos", F.row_number().over(w))


def league_summary(matches: DataFrame) -> DataFrame:
    h, a = F.col("home_goals"), F.col("away_goals")
    avg = lambda c: F.round(F.avg(c.cast("double")), 6)
    return matches.groupBy("league").agg(
        F.count("*").alias("n"), avg(h + a).alias("avg_goals"), avg(h > a).alias("home_rate"), avg(h == a).alias("draw_rate"), avg(h < a).alias("away_rate"),
        F.round(F.avg((h > a).cast("double")) - F.avg((h < a).cast("double")), 6).alias("home_adv"), avg((h > 0) & (a > 0)).alias("btts"),
        *[avg(h + a > k).alias(f"over{k}5") for k in range(5)], *[_n((h + a == k) if k < 4 else (h + a >= 4)).alias(f"goals_{k}") for k in range(5)],
        F.sum(F.col("home_corners") + F.col("away_corners")).cast("long").alias("corners"),
    )


def kpis(matches: DataFrame, long: DataFrame) -> DataFrame:
    """One row over everything; teams are the union of both sides."""
    h, a = F.col("home_goals"), F.col("away_goals")
    one = matches.agg(F.count("*").alias("n"), F.countDistinct("league").alias("leagues"), F.round(F.avg((h + a).cast("double")), 6).alias("avg_goals"), F.round(F.avg((h > a).cast("double")), 6).alias("home_rate"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    return one.crossJoin(long.agg(F.countDistinct("team").alias("teams")))


def coverage(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Share of non-null values per key and column, long."""
    wide = df.groupBy(*keys).agg(*[F.round(F.avg(F.col(c).isNotNull().cast("double")), 3).alias(c) for c in columns])
    return wide.unpivot(keys, columns, "feature", "coverage")


def low_coverage(matrix: DataFrame, threshold: float = 0.5) -> DataFrame:
    return matrix.where(F.col("coverage") < threshold)


def fill_means(df: DataFrame, columns: list[str], by: str = "league") -> DataFrame:
    """Null cells from the group's mean, then the overall mean, by two small aggregates joined back (no global window)."""
    groups = df.groupBy(by).agg(*[F.avg(c).alias(f"_g_{c}") for c in columns])
    whole = df.agg(*[F.avg(c).alias(f"_a_{c}") for c in columns])
    made = df.join(groups, by, "left").crossJoin(F.broadcast(whole))
    return made.withColumns({c: F.coalesce(c, f"_g_{c}", f"_a_{c}") for c in columns}).drop(*[f"_{k}_{c}" for k in "ga" for c in columns])


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("data_completeness", 1 - sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) / len(columns))


def team_profile(long: DataFrame) -> DataFrame:
    """Overall, home and away figures per team with the biggest win and the most frequent opponent."""
    gd = F.col("gf") - F.col("ga")
    opp = long.groupBy("league", "team", "opp").agg(F.count("*").alias("c")).groupBy("league", "team").agg(F.max_by("opp", F.struct("c", F.col("opp"))).alias("top_opp"))
    made = long.groupBy("league", "team").agg(
        F.count("*").alias("pl"), F.sum("pts").cast("long").alias("pts"), F.round(F.avg(F.when(F.col("is_home") == 1, F.col("gf")).cast("double")), 6).alias("home_gf"), F.round(F.avg(F.when(F.col("is_home") == 0, F.col("gf")).cast("double")), 6).alias("away_gf"),
        F.max(gd).alias("biggest_win"), F.min(gd).alias("biggest_loss"), _n(F.col("gf") >= 4).alias("four_plus"),
    )
    return made.join(opp, ["league", "team"])


def monthly(long: DataFrame) -> DataFrame:
    return long.groupBy("league", "team", F.month("date").alias("month")).agg(F.count("*").alias("pl"), F.sum("pts").cast("long").alias("pts"))


def matches_per_team(long: DataFrame) -> DataFrame:
    per = long.groupBy("team").agg(F.count("*").alias("n"))
    return per.agg(F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"), _n(F.col("n") < 20).alias("below_20"), _n(F.col("n") < 50).alias("below_50"))


def shares(df: DataFrame, column: str, top: int = 15) -> DataFrame:
    """Counts per value, their share, and the running share of the ``top`` largest."""
    counts = df.groupBy(column).agg(F.count("*").alias("n")).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))
    w = W.orderBy(F.desc("n"), column)
    ranked = counts.orderBy(F.desc("n"), column).limit(top)  # a row for each of the top values
    return ranked.withColumn("share", F.round(F.col("n") / F.col("total"), 6)).withColumn("running", F.round(F.sum("n").over(w) / F.col("total"), 6)).drop("total")


def implied_against_actual(preds: DataFrame) -> DataFrame:
    from touchline.functions import implied, margin

    odds = [F.col(f"odds_{x}") for x in "hda"]
    one = preds.agg(*[F.round(F.avg(implied(F.col(f"odds_{x}"))), 6).alias(f"implied_{x}") for x in "hda"], *[F.round(F.avg((F.col("result") == x.upper()).cast("double")), 6).alias(f"actual_{x}") for x in "hda"], F.round(F.avg(margin(*odds)), 6).alias("margin_mean"), F.round(F.min(margin(*odds)), 6).alias("margin_min"), F.round(F.max(margin(*odds)), 6).alias("margin_max"))
    return one


def correlations(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    wide = df.agg(*[F.round(F.corr(F.col(c).cast("double"), F.col(target).cast("double")), 6).alias(c) for c in columns])
    return wide.unpivot([], columns, "feature", "corr")


def in_order(df: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """Whether match ids follow dates, per league: how many rows are older than the row before them.

    A league's ids are cut into ranges of about ``bucket`` rows (ids that lie close together make larger ones); within them rows meet
    their neighbours, and a second window joins the ends, a row for each range."""
    spans = df.groupBy(F.col("league").alias("_league")).agg(F.min("match_id").alias("_low"), ((F.max("match_id") - F.min("match_id") + 1) / F.ceil(F.count("*") / bucket)).alias("_wide"))
    placed = df.select("league", "match_id", "date").join(spans, F.col("league").eqNullSafe(F.col("_league"))).select("league", "match_id", "date", F.floor((F.col("match_id") - F.col("_low")) / F.col("_wide")).alias("_range"))
    w = W.partitionBy("league", "_range").orderBy("match_id")
    back = placed.withColumn("_b", (F.col("date") < F.lag("date").over(w)).cast("long"))
    ends = back.groupBy("league", "_range").agg(F.sum("_b").alias("_b"), F.min_by("date", "match_id").alias("_first"), F.max_by("date", "match_id").alias("_last"))
    joined = ends.withColumn("_e", (F.col("_first") < F.lag("_last").over(W.partitionBy("league").orderBy("_range"))).cast("long"))
    return joined.groupBy("league").agg((F.coalesce(F.sum("_b"), F.lit(0)) + F.coalesce(F.sum("_e"), F.lit(0))).cast("long").alias("steps_back"))


def usable_columns(df: DataFrame, most_null: float = 0.40) -> list[str]:
    """Numeric columns with a smaller null share; one aggregate, one row to the driver."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte") or f.dataType.typeName().startswith("decimal")]
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in numeric]).first()
    return [c for c in numeric if row[c] is not None and row[c] < most_null]
