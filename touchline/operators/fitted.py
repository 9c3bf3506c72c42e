"""Fitted models: Dixon-Coles by league, calibrators, result classifiers, and threshold tuning."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.operators.evaluation import EPS

STRENGTHS = "league int, team long, attack double, defence double, base double, home double, rho double, n int"


def poisson_strengths(home: np.ndarray, away: np.ndarray, hg: np.ndarray, ag: np.ndarray, teams: int, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Base, home advantage, attacks and defences (logs) by ridge Newton steps on the Poisson likelihood of both sides."""
    n, wide = len(home), 2 + 2 * teams
    x, y, at = np.zeros((2 * n, wide)), np.concatenate([hg, ag]).astype(float), np.arange(n)
    x[:, 0], x[:n, 1] = 1, 1
    x[at, 2 + home] = x[n + at, 2 + away] = 1
    x[at, 2 + teams + away] = x[n + at, 2 + teams + home] = -1
    pull = np.full(wide, ridge * 2 * n)
    pull[:2] = 1e-9
    beta = np.zeros(wide)
    beta[0] = np.log(max(y.mean(), 0.05))
    for _ in range(steps):
        rate = np.exp(np.clip(x @ beta, -6, 3))
        step = np.linalg.solve((x * rate[:, None]).T @ x + np.diag(pull) + 1e-9 * np.eye(wide), x.T @ (y - rate) - pull * beta)
        beta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def low_score_rho(rate_h: np.ndarray, rate_a: np.ndarray, hg: np.ndarray, ag: np.ndarray, times: np.ndarray | float = 1.0) -> float:
    """The low-score correction of largest likelihood on a grid of -0.2 to 0.2; 0 where nothing is better. ``times``: matches a row stands for."""

    def gain(rho: float) -> float:
        t = np.ones(len(hg))
        t = np.where((hg == 0) & (ag == 0), 1 - rate_h * rate_a * rho, t)
        t = np.where((hg == 0) & (ag == 1), 1 + rate_h * rho, t)
        t = np.where((hg == 1) & (ag == 0), 1 + rate_a * rho, t)
        t = np.where((hg == 1) & (ag == 1), 1 - rho, t)
        return float((np.log(np.maximum(t, 1e-9)) * times).sum())

    return float(max(np.round(np.linspace(-0.2, 0.2, 41), 2), key=lambda r: (round(gain(r), 9), -abs(r))))


def _fitted(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    """Strengths of one group's matches; none below ``least``."""
    if len(pdf) < least:
        return pd.DataFrame(columns=[c.split()[0] for c in STRENGTHS.split(", ")])
    pdf = pdf.sort_values("match_id")
    names, ids = np.unique(np.concatenate([pdf.home_team_id, pdf.away_team_id]), return_inverse=True)
    h, a, hg, ag = ids[: len(pdf)], ids[len(pdf) :], pdf.home_goals.to_numpy(), pdf.away_goals.to_numpy()
    beta, k = poisson_strengths(h, a, hg, ag, len(names)), len(names)
    attack, defence = beta[2 : 2 + k], beta[2 + k :]
    rho = low_score_rho(np.exp(beta[0] + beta[1] + attack[h] - defence[a]), np.exp(beta[0] + attack[a] - defence[h]), hg, ag)
    return pd.DataFrame({"league": int(pdf.league.iloc[0]), "team": names, "attack": attack, "defence": defence, "base": beta[0], "home": beta[1], "rho": rho, "n": len(pdf)})


def _numbers() -> list[Column]:
    return [F.col("league").cast("int").alias("league"), "match_id", *[F.col(c).cast("long").alias(c) for c in ("home_team_id", "away_team_id", "home_goals", "away_goals")]]


def dixon_coles(matches: DataFrame, last: int = 600, least: int = 20) -> DataFrame:
    """Team strengths of each league from its last ``last`` matches: rates first, then the low-score correction.

    Leagues with fewer than ``least`` matches get none. Spark keeps ``last`` rows of a league before the shuffle already, so
    no task holds more than that of one league."""
    w = W.partitionBy("league").orderBy(F.desc("date"), F.desc("match_id"))
    kept = matches.where("home_goals is not null and away_goals is not null").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last)
    return kept.select(*_numbers()).groupBy("league").applyInPandas(lambda pdf: _fitted(pdf, least), STRENGTHS)


def rolling_rates(matches: DataFrame, fixtures: DataFrame, days: int = 365, last: int = 600, least: int = 20) -> DataFrame:
    """``fixtures`` with lh and la by strengths that are refitted each ``days`` days from a league's first fixture on.

    A period's fit takes the last ``last`` matches of the league before the period's first day. Of each earlier period no
    more than the last ``last`` matches are candidates, so rows grow with the square of the number of periods only."""
    begin = fixtures.groupBy("league").agg(F.to_date(F.min("date")).alias("_begin"))
    placed = lambda df: df.join(F.broadcast(begin), "league").withColumn("_period", F.floor(F.datediff(F.to_date("date"), "_begin") / days).cast("int")).drop("_begin")
    asked = placed(fixtures)
    recent = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("date"), F.desc("match_id")))
    known = placed(matches.where("home_goals is not null and away_goals is not null")).select(*_numbers(), "date", F.col("_period").alias("_own"))
    known = known.withColumn("_rn", recent("league", "_own")).where(F.col("_rn") <= last)
    periods = asked.select(F.col("league").cast("int").alias("league"), "_period").distinct()
    taken = known.join(F.broadcast(periods), "league").where(F.col("_own") < F.col("_period")).withColumn("_rn", recent("league", "_period")).where(F.col("_rn") <= last)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return _fitted(pdf, least).assign(_period=pdf._period.iloc[0])

    made = taken.select(*[c for c in known.columns if c[0] != "_" and c != "date"], "_period").groupBy("league", "_period").applyInPandas(fit, STRENGTHS + ", _period int")
    return goal_rates(asked, made, by=("league", "_period")).drop("_period")


def goal_rates(fixtures: DataFrame, strengths: DataFrame, default_total: float = 2.6, by: tuple[str, ...] = ("league",)) -> DataFrame:
    """``fixtures`` (match_id, league, home_team_id, away_team_id, ...) with expected goals lh and la. A team that is not
    known counts as average; a league (or other ``by``) without a fit gets half of ``default_total`` each, times 1.1 at home and 0.9 away."""
    keys = lambda s: [F.col(k).alias(f"_k{s}{i}") for i, k in enumerate(by)]
    same = lambda s: reduce(and_, [F.col(k) == F.col(f"_k{s}{i}") for i, k in enumerate(by)])
    per = strengths.groupBy(*keys("")).agg(F.first("base").alias("_b"), F.first("home").alias("_h"))
    side = lambda s: strengths.select(*keys(s), F.col("team").alias(f"_t{s}"), F.col("attack").alias(f"_a{s}"), F.col("defence").alias(f"_d{s}"))
    df = fixtures.join(per, same(""), "left")
    for s, team in (("h", "home_team_id"), ("a", "away_team_id")):
        df = df.join(side(s), same(s) & (F.col(team) == F.col(f"_t{s}")), "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    lh = F.coalesce(F.exp(F.col("_b") + F.col("_h") + z("_ah") - z("_da")), F.lit(default_total / 2 * 1.1))
    la = F.coalesce(F.exp(F.col("_b") + z("_aa") - z("_dh")), F.lit(default_total / 2 * 0.9))
    return df.select(*fixtures.columns, lh.alias("lh"), la.alias("la"))


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.ln(q / (1 - q))


def _vector(df: DataFrame, cols: list[str], out: str = "_x") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error").transform(df)


def platt(train: DataFrame, df: DataFrame, label: str, score: str, out: str = "platt") -> DataFrame:
    """``df`` with a logistic curve of the score's logit, fitted on ``train``."""
    prepared = lambda d: _vector(d.withColumn("_z", logit(F.col(score))), ["_z"])
    model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=50).fit(prepared(train.withColumn("_y", F.col(label).cast("double"))))
    made = model.setPredictionCol("_p").setRawPredictionCol("_r").setProbabilityCol("_q").transform(prepared(df))
    return made.select(*df.columns, F.get(vector_to_array("_q"), F.lit(1)).alias(out))


def beta_curve(train: DataFrame, df: DataFrame, label: str, score: str, out: str = "beta") -> DataFrame:
    """``df`` with a beta calibration: a logistic curve of ln p and -ln(1 - p), fitted on ``train``."""
    q = F.greatest(F.least(F.col(score), F.lit(1 - 1e-6)), F.lit(1e-6))
    prepared = lambda d: _vector(d.withColumns({"_u": F.ln(q), "_v": -F.ln(1 - q)}), ["_u", "_v"])
    model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=50).fit(prepared(train.withColumn("_y", F.col(label).cast("double"))))
    made = model.setPredictionCol("_p").setRawPredictionCol("_r").setProbabilityCol("_q").transform(prepared(df))
    return made.select(*df.columns, F.get(vector_to_array("_q"), F.lit(1)).alias(out))


def isotonic(train: DataFrame, df: DataFrame, label: str, score: str, out: str = "isotonic", digits: int = 4) -> DataFrame:
    """``df`` with the monotone step curve of ``train``. Scores are first counted by value to ``digits`` places with weights,
    so the fit sees at most 10^digits + 1 rows, however many there are."""
    counted = train.groupBy(F.round(score, digits).alias("_s")).agg(F.avg(F.col(label).cast("double")).alias("_y"), F.count("*").cast("double").alias("_w"))
    model = IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w").fit(_vector(counted, ["_s"]))
    made = model.setPredictionCol(out).transform(_vector(df.withColumn("_s", F.col(score)), ["_s"]))
    return made.select(*df.columns, out)


def best_calibration(train: DataFrame, df: DataFrame, label: str, score: str, least_gain: float = 1e-3) -> DataFrame:
    """method and log_loss on ``df`` of no calibration and the three curves; ``chosen`` marks the best if it gains
    ``least_gain`` on none, else none. A row per method."""
    made = isotonic(train, beta_curve(train, platt(train, df, label, score), label, score), label, score)
    y = F.col(label).cast("double")
    loss = lambda c: F.avg(-F.ln(F.greatest(F.when(y == 1, F.col(c)).otherwise(1 - F.col(c)), F.lit(EPS))))
    names = {"none": score, "platt": "platt", "beta": "beta", "isotonic": "isotonic"}
    per = made.agg(*[loss(c).alias(k) for k, c in names.items()]).select(F.inline(F.array(*[F.struct(F.lit(k).alias("method"), F.col(k).alias("log_loss")) for k in names])))
    w = W.partitionBy(F.lit(1))  # four rows
    none = F.max(F.when(F.col("method") == "none", F.col("log_loss"))).over(w)
    best = F.min_by("method", "log_loss").over(w)
    return per.withColumn("chosen", F.col("method") == F.when(none - F.min("log_loss").over(w) >= least_gain, best).otherwise("none"))


def result_model(train: DataFrame, df: DataFrame, features: list[str], label: str, kind: str = "logistic", seed: int = 7) -> DataFrame:
    """``df`` with an array of class probabilities by Spark's logistic (any number of classes) or boosted trees (two classes).
    ``label`` holds 0, 1, ...; rows of ``train`` with a null feature or label are left out, those of ``df`` are scored with 0 for null."""
    est = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=50, regParam=1e-3) if kind == "logistic" else GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=20, maxDepth=3, seed=seed)
    model = est.fit(_vector(train.withColumn("_y", F.col(label).cast("double")).dropna(subset=[*features, "_y"]), features))
    filled = df.withColumns({f"_f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)})
    made = model.setPredictionCol("_p").setRawPredictionCol("_r").setProbabilityCol("_q").transform(_vector(filled, [f"_f{i}" for i in range(len(features))]))
    return made.select(*df.columns, vector_to_array("_q").alias("probabilities"))


def best_threshold(df: DataFrame, label: str, score: str, lo: float = 0.25, step: float = 0.05, n: int = 11) -> DataFrame:
    """F1 at each threshold and the best one (the lowest on ties). Rows are counted once per step; thresholds add up the steps."""
    k = F.floor((F.col(score) - lo) / step + 1e-9)
    counted = df.groupBy(F.least(F.greatest(k, F.lit(-1)), F.lit(n - 1)).alias("k")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    grid = df.sparkSession.range(n).withColumn("threshold", F.round(F.lit(lo) + F.col("id") * step, 6))
    counted = counted.withColumn("total", F.sum("pos").over(W.partitionBy(F.lit(1))))  # n + 1 rows
    at = grid.join(F.broadcast(counted), F.col("k") >= F.col("id"), "left")
    per = at.groupBy("threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("picks"), F.max("total").alias("total"))
    per = per.withColumn("f1", F.round(2 * F.col("tp") / F.nullif(F.col("picks") + F.max("total").over(W.partitionBy(F.lit(1))), F.lit(0)), 6))
    top = F.first("threshold").over(W.orderBy(F.desc_nulls_last("f1"), "threshold"))
    return per.select("threshold", "tp", "picks", "f1", (F.col("threshold") == top).alias("best"))


def closed_form_1x2(home: Column, away: Column, rho: Column, most: int = 10) -> dict[str, Column]:
    """Result probabilities of the corrected scores, normalised; the correction moves mass between the four low scores only."""
    from touchline.functions import poisson_pmf

    step = lambda acc, p: F.struct((acc["below"] + p[1]).alias("below"), (acc["win"] + p[0] * acc["below"]).alias("win"), (acc["draw"] + p[0] * p[1]).alias("draw"), (acc["h"] + p[0]).alias("h"))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("below", "win", "draw", "h")])
    ph, pa = poisson_pmf(home, most), poisson_pmf(away, most)
    w = F.aggregate(F.zip_with(ph, pa, lambda p, q: F.array(p, q)), zero, step)
    base = F.exp(-home - away)
    draw = w["draw"] - base * home * away * rho * 2  # both corrected draws lose the same: p(0,0) h a rho, and p(1,1) rho = p(0,0) h a rho
    win, total = w["win"] + base * home * away * rho, w["h"] * w["below"]
    return {"p_h": win / total, "p_d": draw / total, "p_a": 1 - (win + draw) / total}
