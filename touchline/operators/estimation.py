"""Models fitted from sums: what the driver solves is one row of aggregates (or a table bounded by the number of teams kept), however many matches there are."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.decisions import convolved, negative_binomial_pmf
from touchline.operators.fitted import low_score_rho

#: The twelve statistics that may be missing, and those that completeness counts.
STATS = ["home_shots", "away_shots", "home_sot", "away_sot", "home_corners", "away_corners", "home_yellow", "away_yellow", "home_red", "away_red", "home_fouls", "away_fouls"]
COMPLETE = STATS[:8]


@dataclass(frozen=True)
class StatModels:
    """Linear models of the targets that had enough rows: a row of coefficients each, the constant first."""

    features: list[str]
    coefficients: dict[str, np.ndarray]


def _inputs(features: list[str]) -> list[Column]:
    return [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]]


def _products(p: int):
    """Sums over a task's rows of the products of the first ``p`` columns with all columns (null: 0) and with whether the others are known."""

    def run(batches):
        total = 0.0
        for b in batches:
            cols = [np.asarray(c.fill_null(0.0)) for c in b.columns]
            seen = [np.asarray(c.is_valid().cast("double")) for c in b.columns[p:]]
            total = total + np.stack(cols[:p]) @ np.stack([*cols, *seen]).T
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["at", "part"])

    return run


def stat_models(matches: DataFrame, features: list[str], targets: list[str] = STATS, ridge: float = 1e-3, least: int = 1000, least_known: int = 500) -> StatModels:
    """Least squares with a small ridge for all targets at once from one Gram matrix.

    Rows with any target known teach; a null feature counts as 0, a null target as the target's mean. There is no model for a
    target known in fewer than ``least_known`` rows, and none at all below ``least`` rows."""
    targets = [t for t in targets if t in matches.columns]
    x, p = _inputs(features), len(features) + 1
    known = F.coalesce(*[F.col(t).cast("double") for t in targets]) if targets else F.lit(None)
    rows = matches.where(known.isNotNull()).select(*[c.alias(f"_x{i}") for i, c in enumerate(x)], *[F.col(t).cast("double").alias(f"_y{i}") for i, t in enumerate(targets)])
    parts, k = np.zeros(p * (p + 2 * len(targets))), len(targets)
    for r in rows.mapInArrow(_products(p), "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect():
        parts[r["at"]] = r["part"]
    gram, ys, ks = np.split(parts.reshape(p, p + 2 * k), [p, p + k], axis=1)
    n, made = gram[0, 0], {}
    pull = np.diag([0.0] + [ridge * n] * (p - 1))
    for i, t in enumerate(targets if n >= least else []):
        have, seen = ks[:, i], ys[:, i]
        if have[0] >= least_known:
            made[t] = np.linalg.solve(gram + pull, seen + seen[0] / have[0] * (gram[0] - have))
    return StatModels(list(features), made)


def stats_filled(matches: DataFrame, models: StatModels) -> DataFrame:
    """Null statistics from the models: not below 0, whole numbers (half to even), red cards 3 at most. Known cells stay. A column
    ``data_completeness`` becomes the mean of itself and the share of the first eight statistics that are known then."""
    x = _inputs(models.features)
    said = {t: F.rint(F.greatest(sum((float(b) * c for b, c in zip(beta[1:], x[1:], strict=True)), F.lit(float(beta[0]))), F.lit(0.0))) for t, beta in models.coefficients.items()}
    said = {t: F.least(v, F.lit(3.0)) if t.endswith("_red") else v for t, v in said.items()}
    made = matches.withColumns({t: F.coalesce(F.col(t), v.cast(matches.schema[t].dataType)) for t, v in said.items()}) if said else matches
    if "data_completeness" not in matches.columns:
        return made
    share = sum((F.col(c).isNotNull().cast("double") for c in COMPLETE if c in made.columns), F.lit(0.0)) / len(COMPLETE)
    return made.withColumn("data_completeness", (F.coalesce("data_completeness", share) + share) / 2)


STRENGTHS = "league int, team long, attack double, defence double, base double, home double, rho double, n int"


def global_strengths(matches: DataFrame, top: int = 300, least: int = 20, ridge: float = 1e-3) -> DataFrame:
    """One Dixon-Coles fit over all matches of all leagues: the ``top`` teams by matches (ties: the smaller id), all others as one team -1.

    The likelihood needs each pair's matches, goals and low scores only, so the matches are summed to no more than
    (top + 1) squared rows, and the driver solves the rates by Newton steps on those sums. Strengths as of a league 0."""
    played = matches.where("home_goals is not null and away_goals is not null")
    sides = matches.select(F.explode(F.array("home_team_id", "away_team_id")).alias("team")).groupBy("team").agg(F.count("*").alias("n"))
    known = sides.orderBy(F.desc("n"), "team").limit(top).select("team")
    named = lambda df, c: df.join(known.select(F.col("team").alias(f"_{c}")), F.col(c) == F.col(f"_{c}"), "left").withColumn(c, F.coalesce(f"_{c}", F.lit(-1)).cast("long")).drop(f"_{c}")
    pairs = played.groupBy("home_team_id", "away_team_id").agg(*_sums())  # before the names, so that these joins see pairs only
    cells = named(named(pairs, "home_team_id"), "away_team_id").groupBy("home_team_id", "away_team_id").agg(*[F.sum(c).cast("double").alias(c) for c in CELLS])
    made = _solved(cells.toArrow(), least, ridge)
    return matches.sparkSession.createDataFrame(made, STRENGTHS)


CELLS = ("n", "hg", "ag", "s00", "s01", "s10", "s11")


def _sums() -> list[Column]:
    score = lambda h, a: F.count(F.when((F.col("home_goals") == h) & (F.col("away_goals") == a), 1))
    return [F.count("*").alias("n"), F.sum("home_goals").alias("hg"), F.sum("away_goals").alias("ag"), *[score(h, a).alias(f"s{h}{a}") for h in (0, 1) for a in (0, 1)]]


def _solved(cells, least: int, ridge: float) -> list[tuple]:
    home, away = cells.column("home_team_id").to_numpy(), cells.column("away_team_id").to_numpy()
    names, at = np.unique(np.concatenate([home, away]), return_inverse=True)
    k, (h, a) = len(names), np.split(at, 2)
    m = {c: np.zeros((k, k)) for c in CELLS}
    for c in CELLS:
        m[c][h, a] = cells.column(c).to_numpy()
    if m["n"].sum() < least:
        return []
    base, edge, attack, defence = pair_strengths(m["n"], m["hg"], m["ag"], ridge)
    lh, la = np.exp(base + edge + attack[:, None] - defence), np.exp(base + attack - defence[:, None])
    scores = [(s, *np.nonzero(m[f"s{s[0]}{s[1]}"])) for s in ((0, 0), (0, 1), (1, 0), (1, 1))]
    hg, ag = (np.concatenate([np.full(len(i), s[part]) for s, i, _ in scores]) for part in (0, 1))
    rates = [np.concatenate([rate[i, j] for _, i, j in scores]) for rate in (lh, la)]
    times = np.concatenate([m[f"s{s[0]}{s[1]}"][i, j] for s, i, j in scores])
    rho = low_score_rho(*rates, hg, ag, times)
    return [(0, int(t), float(x), float(y), float(base), float(edge), rho, int(m["n"].sum())) for t, x, y in zip(names, attack, defence, strict=True)]


def pair_strengths(n: np.ndarray, hg: np.ndarray, ag: np.ndarray, ridge: float, steps: int = 50) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Base, home advantage, attacks and defences (logs) from each pair's matches and goals (home by away): Newton steps on
    the Poisson likelihood of both sides with a ridge of ``ridge`` times the number of sides."""
    k = len(n)
    beta, pull = np.zeros(2 + 2 * k), np.full(2 + 2 * k, ridge * 2 * n.sum())
    pull[:2] = 1e-9
    beta[0] = np.log(max((hg.sum() + ag.sum()) / (2 * n.sum()), 0.05))
    for _ in range(steps):
        attack, defence = beta[2 : 2 + k], beta[2 + k :]
        lh = n * np.exp(np.clip(beta[0] + beta[1] + attack[:, None] - defence, -6, 3))
        la = n * np.exp(np.clip(beta[0] + attack - defence[:, None], -6, 3))
        dh, da = hg - lh, ag - la
        slope = np.concatenate([[dh.sum() + da.sum(), dh.sum()], dh.sum(1) + da.sum(0), -dh.sum(0) - da.sum(1)]) - pull * beta
        bend = np.zeros((2 + 2 * k, 2 + 2 * k))
        by_attack, by_defence = lh.sum(1) + la.sum(0), lh.sum(0) + la.sum(1)
        bend[0, 0], bend[1, 1] = (lh + la).sum(), lh.sum()
        bend[0, 1] = bend[1, 0] = lh.sum()
        bend[0, 2:] = bend[2:, 0] = np.concatenate([by_attack, -by_defence])
        bend[1, 2:] = bend[2:, 1] = np.concatenate([lh.sum(1), -lh.sum(0)])
        cross = -(lh + la.T)
        bend[2:, 2:] = np.block([[np.diag(by_attack), cross], [cross.T, np.diag(by_defence)]])
        step = np.linalg.solve(bend + np.diag(pull + 1e-9), slope)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-10:
            break
    return beta[0], beta[1], beta[2 : 2 + k], beta[2 + k :]


def mixture_weights(df: DataFrame, scores: list[str], steps: int = 30) -> np.ndarray:
    """Weights of models on the simplex that minimise the mean log-loss of their weighted mean; ``scores`` are the columns with
    each model's probability of what happened.

    A step takes the slope and the curvature at the present weights from one aggregate and solves for the next on the driver
    (as many numbers as models squared); steps that do not help are halved."""
    k = len(scores)
    p = [F.greatest(F.col(c).cast("double"), F.lit(1e-15)) for c in scores]

    def look(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        mix = sum((float(x) * c for x, c in zip(w, p, strict=True)), F.lit(0.0))
        row = df.agg(F.avg(-F.ln(mix)).alias("loss"), *[F.avg(-c / mix).alias(f"d{i}") for i, c in enumerate(p)], *[F.avg(p[i] * p[j] / (mix * mix)).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        bend = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        return row["loss"], np.array([row[f"d{i}"] for i in range(k)]), bend

    w = np.full(k, 1 / k)
    loss, slope, bend = look(w)
    for _ in range(steps):
        to = _on_simplex(slope - bend @ w, bend, w)
        share = 1.0
        while True:
            new = (1 - share) * w + share * to
            made = look(new)
            if made[0] <= loss or share < 1e-4:
                break
            share /= 2
        moved = np.abs(new - w).max()
        if made[0] <= loss:
            w, (loss, slope, bend) = new, made
        if moved < 1e-9 or share < 1e-4:
            break
    return w


def _on_simplex(slope: np.ndarray, bend: np.ndarray, w: np.ndarray, steps: int = 20_000) -> np.ndarray:
    """The least of slope w + w bend w / 2 on the simplex, by accelerated projected steps."""
    rate = 1 / max(np.linalg.eigvalsh(bend)[-1], 1e-12)
    at, t = w, 1.0
    for _ in range(steps):
        v = at - rate * (slope + bend @ at)
        u = np.sort(v)[::-1]
        over = np.cumsum(u) - 1
        k = np.flatnonzero(u > over / np.arange(1, len(u) + 1))[-1]
        new = np.maximum(v - over[k] / (k + 1), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, done = new + (t - 1) / t_new * (new - w), np.abs(new - w).max() < 1e-13
        w, t = new, t_new
        if done:
            break
    return w


def temperature(df: DataFrame, probabilities: list[str], happened: str, low: float = 0.05, high: float = 20.0, points: int = 24, close: float = 1e-7) -> float:
    """The temperature that minimises the log-loss of p^(1/T), normalised; ``happened`` is the index of the outcome. Each pass looks at
    ``points`` temperatures in one aggregate and keeps the interval around the best, on a log scale (the loss has one minimum in 1/T)."""
    logs = [F.ln(F.greatest(F.col(c).cast("double"), F.lit(1e-15))) for c in probabilities]
    own = F.get(F.array(*logs), F.col(happened).cast("int"))
    most = F.greatest(*logs) if len(logs) > 1 else logs[0]
    a, b = np.log(low), np.log(high)
    while b - a > close:
        grid = np.linspace(a, b, points)
        loss = [F.avg(F.ln(sum((F.exp((x - most) / float(np.exp(g))) for x in logs), F.lit(0.0))) - (own - most) / float(np.exp(g))).alias(f"t{i}") for i, g in enumerate(grid)]
        k = int(np.argmin(df.agg(*loss).first()))
        a, b = grid[max(k - 1, 0)], grid[min(k + 1, points - 1)]
    return float(np.exp((a + b) / 2))


def count_spreads(df: DataFrame, count: str, by: list[str]) -> DataFrame:
    """Per group n, mean and alpha = variance / mean - 1, 0.01 at least (0.5 for a mean of 0): the excess of a negative binomial over Poisson."""
    x = F.col(count).cast("double")
    made = df.where(x.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("_v"))
    return made.withColumn("alpha", F.when(F.col("mean") > 0, F.greatest(F.lit(0.01), F.col("_v") / F.col("mean") - 1)).otherwise(0.5)).drop("_v")


def _summing_to_one(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda t, x: t + x)
    return F.transform(p, lambda x: x / total)


def fitted_count_overs(train: DataFrame, df: DataFrame, home: str, away: str, by: list[str], lines: tuple[int, ...], most: int = 20) -> DataFrame:
    """``df`` with over<line>5 of home and away counts together: negative binomials with each group's mean and alpha of ``train``, each cut
    at ``most`` and made to sum to 1. Groups that ``train`` lacks get nulls."""
    keys = [F.col(k).alias(f"_{k}") for k in by]
    groups = None
    for side, c in (("h", home), ("a", away)):
        mean = F.greatest("mean", F.lit(0.05))
        own = count_spreads(train, c, by).select(*keys, mean.alias("_m"), F.greatest(mean / F.greatest("alpha", F.lit(1e-3)), F.lit(0.05)).alias("_r"))
        own = own.select(*[f"_{k}" for k in by], _summing_to_one(negative_binomial_pmf(F.col("_m"), F.col("_r"), most)).alias(f"_{side}p"))
        groups = own if groups is None else groups.join(own, [f"_{k}" for k in by])
    below = lambda k: F.aggregate(F.slice("_t", 1, k + 1), F.lit(0.0), lambda s, x: s + x)
    groups = groups.withColumn("_t", convolved(F.col("_hp"), F.col("_ap"), max(lines))).select(*[f"_{k}" for k in by], *[(1 - below(k)).alias(f"over{k}5") for k in lines])  # a row for each group
    return df.join(groups, reduce(and_, [F.col(k) == F.col(f"_{k}") for k in by]), "left").drop(*[f"_{k}" for k in by])
