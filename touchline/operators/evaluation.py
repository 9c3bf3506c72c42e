"""Metrics, folds, betting and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-12


def _grid(spark: SparkSession, lo: float, step: float, n: int, name: str = "threshold") -> DataFrame:
    """n values from lo, a step apart: a tiny table for threshold sweeps."""
    return spark.range(n).select(F.round(F.lit(lo) + F.col("id") * step, 6).alias(name))


def picked(mode: str = "argmax") -> Column:
    """The predicted result; ties go to H, then D. ``reference`` keeps the published ladder, in which D cannot occur."""
    if mode == "reference":
        return F.when(F.col("p_h") >= F.col("p_d"), "H").when(F.col("p_a") >= F.col("p_h"), "A").when(F.col("p_a") >= F.col("p_d"), "D").otherwise("H")
    top = F.greatest("p_h", "p_d", "p_a")
    return F.when(F.col("p_h") == top, "H").when(F.col("p_d") == top, "D").otherwise("A")


def p_of_result() -> Column:
    return F.when(F.col("result") == "H", F.col("p_h")).when(F.col("result") == "D", F.col("p_d")).otherwise(F.col("p_a"))


def log_loss() -> Column:
    return -F.ln(F.greatest(F.least(p_of_result(), F.lit(1 - EPS)), F.lit(EPS)))


def brier() -> Column:
    return sum((F.pow(F.col(f"p_{x}") - F.when(F.col("result") == x.upper(), 1.0).otherwise(0.0), 2) for x in "hda"), F.lit(0.0))


def scores(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, log-loss, Brier score and accuracy, per group."""
    hit = (picked() == F.col("result")).cast("double")
    return preds.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.round(F.avg(log_loss()), 6).alias("log_loss"), F.round(F.avg(brier()), 6).alias("brier"), F.round(F.avg(hit), 6).alias("accuracy"))


def confusion(preds: DataFrame) -> DataFrame:
    return preds.groupBy(picked().alias("predicted"), F.col("result").alias("actual")).agg(F.count("*").alias("n"))


def class_report(preds: DataFrame, mode: str = "argmax") -> DataFrame:
    """Precision, recall and F1 of each class that occurs on either side."""
    made = preds.select(picked(mode).alias("p"), "result")
    both = made.select(F.explode(F.array(F.struct(F.col("p").alias("k"), F.lit(1).alias("pred"), F.lit(0).alias("act"), (F.col("p") == F.col("result")).cast("int").alias("hit")), F.struct(F.col("result").alias("k"), F.lit(0).alias("pred"), F.lit(1).alias("act"), F.lit(0).alias("hit")))).alias("s")).select("s.*")
    per = both.groupBy(F.col("k").alias("class")).agg(F.sum("pred").alias("pred"), F.sum("act").alias("act"), F.sum("hit").alias("hit"))
    return per.select("class", F.round(F.col("hit") / F.nullif("pred", F.lit(0)), 6).alias("precision"), F.round(F.col("hit") / F.nullif("act", F.lit(0)), 6).alias("recall"), F.round(2 * F.col("hit") / F.nullif(F.col("pred") + F.col("act"), F.lit(0)), 6).alias("f1"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve with ties at half. Scores are counted by value first; the running count goes over distinct
    values inside value ranges, whose totals are added up apart, so no window holds all rows."""
    per = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    per = per.withColumn("part", F.floor(F.col("s") * 64))
    parts = per.groupBy("part").agg(F.sum("neg").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    below = F.sum("neg").over(W.partitionBy("part").orderBy("s")) - F.col("neg")
    ranked = per.withColumn("below", below).join(parts, "part")
    return ranked.agg((F.sum(F.col("pos") * (F.col("base") + F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def calibration(df: DataFrame, label: str, score: str, bins: int = 10, compat: bool = False) -> DataFrame:
    """Bins with size, mean score and rate. The last bin is closed. ``compat`` counts inner edges in both bins, as published."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    ks = F.when((b > 0) & (F.col(score) * bins == b), F.array(b - 1, b)).otherwise(F.array(b)) if compat else F.array(b)
    return df.select(F.explode(ks).alias("bin"), F.col(label).cast("double").alias("_y"), F.col(score).alias("_p")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("_p").alias("mean_p"), F.avg("_y").alias("rate"))


def calibration_error(df: DataFrame, label: str, score: str, bins: int = 10, compat: bool = False) -> DataFrame:
    made = calibration(df, label, score, bins, compat)
    total = df.agg(F.count("*").alias("total"))
    return made.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.col("n") / F.col("total") * F.abs(F.col("mean_p") - F.col("rate"))), 6).alias("ece"))


def goal_errors(df: DataFrame, actual: str, pred: str) -> DataFrame:
    y, p = F.col(actual).cast("double"), F.greatest(F.col(pred), F.lit(EPS))
    deviance = 2 * (F.when(y > 0, y * F.ln(F.greatest(y, F.lit(EPS)) / p)).otherwise(0.0) - (y - p))
    return df.agg(F.round(F.avg(F.abs(y - p)), 6).alias("mae"), F.round(F.sqrt(F.avg((y - p) * (y - p))), 6).alias("rmse"), F.round(F.avg(deviance), 6).alias("deviance"))


def threshold_sweep(preds: DataFrame, lo: float = 0.35, step: float = 0.05, n: int = 8) -> DataFrame:
    """Picks and hits at confidence thresholds. Rows are counted once per step of confidence and joined with the thresholds."""
    top = F.greatest("p_h", "p_d", "p_a")
    counted = preds.groupBy(F.floor((top - lo) / step + 1e-9).alias("k")).agg(F.count("*").alias("n"), F.sum((picked() == F.col("result")).cast("long")).alias("hit"))
    grid = _grid(preds.sparkSession, lo, step, n).withColumn("at", F.round((F.col("threshold") - lo) / step).cast("long"))
    joined = grid.join(F.broadcast(counted), F.col("k") >= F.col("at"))
    return joined.groupBy("threshold").agg(F.sum("n").alias("picks"), F.sum("hit").alias("hits"))


def folds(df: DataFrame, start: str, months: int = 3, n: int = 4) -> DataFrame:
    """Each row's walk-forward test fold (null before the first)."""
    k = F.floor(F.months_between(F.trunc("date", "month"), F.lit(start).cast("date")) / months)
    return df.withColumn("fold", F.when((k >= 0) & (k < n), k.cast("int")))


def value_bets(df: DataFrame, threshold: float = 0.03) -> DataFrame:
    """The outcome with the largest edge p * odds - 1, if above the threshold; -1 for none."""
    edges = {x: F.col(f"p_{x}") * F.col(f"odds_{x}") - 1 for x in "hda"}
    best = F.greatest(*edges.values())
    pick = F.when(best < threshold, -1).when(edges["h"] == best, 0).when(edges["d"] == best, 1).otherwise(2)
    return df.withColumns({"edge": best, "selection": pick})


def kelly(p: Column, odds: Column, fraction: float = 1.0, cap: float = 0.25) -> Column:
    raw = F.when(odds > 1, (p * odds - 1) / F.nullif(odds - 1, F.lit(0.0))).otherwise(0.0)
    return F.least(F.greatest(raw * fraction, F.lit(0.0)), F.lit(cap))


def betting_report(df: DataFrame, threshold: float = 0.03, stake: float = 1.0, compat: bool = False, by: list[str] | None = None) -> DataFrame:
    """Bets, hits and return. A lost bet costs its stake; ``compat`` leaves that out, as published, and cannot go below 0."""
    bets = value_bets(df, threshold).where("selection >= 0")
    odds = F.when(F.col("selection") == 0, F.col("odds_h")).when(F.col("selection") == 1, F.col("odds_d")).otherwise(F.col("odds_a"))
    won = F.element_at(F.array(F.lit("H"), F.lit("D"), F.lit("A")), F.col("selection") + 1) == F.col("result")
    gain = F.when(won, stake * (odds - 1)).otherwise(0.0 if compat else -stake)
    return bets.groupBy(*(by or [])).agg(F.count("*").alias("bets"), F.sum(won.cast("long")).alias("hits"), F.round(F.sum(gain) / F.nullif(F.count("*") * stake, F.lit(0.0)), 6).alias("roi"))


def tune_edge(df: DataFrame, lo: float = 0.0, step: float = 0.02, n: int = 7) -> DataFrame:
    """The report for each edge threshold: one pass per row, then sums from the highest step down."""
    made = value_bets(df, -10.0)
    odds = F.when(F.col("selection") == 0, F.col("odds_h")).when(F.col("selection") == 1, F.col("odds_d")).otherwise(F.col("odds_a"))
    won = F.element_at(F.array(F.lit("H"), F.lit("D"), F.lit("A")), F.col("selection") + 1) == F.col("result")
    counted = made.groupBy(F.floor((F.col("edge") - lo) / step).alias("k")).agg(F.count("*").alias("n"), F.sum(F.when(won, odds - 1).otherwise(-1.0)).alias("g"))
    grid = _grid(df.sparkSession, lo, step, n).withColumn("at", F.round((F.col("threshold") - lo) / step).cast("long"))
    return grid.join(F.broadcast(counted), F.col("k") >= F.col("at")).groupBy("threshold").agg(F.sum("n").alias("bets"), F.round(F.sum("g") / F.sum("n"), 6).alias("roi"))


def clv(df: DataFrame, taken: str, closing: str) -> DataFrame:
    return df.withColumn("clv", F.col(taken) / F.nullif(F.col(closing), F.lit(0.0)) - 1)


def closing(snapshots: DataFrame, keys: list[str], price: str, at: str, tie: str) -> DataFrame:
    """The last price of each key."""
    return snapshots.groupBy(*keys).agg(F.max_by(price, F.struct(at, tie)).alias("closing"), F.min_by(price, F.struct(at, tie)).alias("opening"), F.count("*").alias("snapshots"))


def drift(preds: DataFrame, period: Column, by: str = "period") -> DataFrame:
    """Period scores against the period before, with alarms."""
    per = scores(preds.withColumn(by, period), [by])
    w = W.orderBy(by)  # a row for each period
    change = lambda c: F.col(c) - F.lag(c).over(w)
    made = per.withColumns({"d_brier": change("brier"), "d_log_loss": change("log_loss"), "d_accuracy": change("accuracy")})
    return made.withColumn("alarm", F.coalesce((F.col("d_brier") >= 0.02) | (F.col("d_log_loss") >= 0.03) | (F.col("d_accuracy") <= -0.03), F.lit(False)))
