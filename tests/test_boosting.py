"""Boosting against planted structure that a logistic model cannot hold, and against hand-worked first trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import boosting, fitted


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3))
    margin = np.stack([1.5 * np.sign(x[:, 0] * x[:, 1]), np.zeros(3000), np.abs(x[:, 2])], axis=1)
    p = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
    y = (p.cumsum(axis=1) > rng.random((3000, 1))).argmax(axis=1)
    goals = rng.poisson(np.exp(0.2 + 0.6 * (x[:, 0] * x[:, 1] > 0)))
    rows = [(k, *map(float, r), int(c), int(g)) for k, (r, c, g) in enumerate(zip(x, y, goals, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, goals int").persist()


def test_softmax_beats_the_logistic_where_features_act_together(planted):
    train, rest = planted.where("id < 2200"), planted.where("id >= 2200")
    model = boosting.boosted(train, ["a", "b", "c"], "y", boosting.Boosting(rounds=12, rate=0.4))
    loss = lambda df: df.agg(F.avg(-F.ln(F.get("probabilities", F.col("y"))))).first()[0]
    made = boosting.boosted_scores(rest, model)
    sums = made.select(F.aggregate("probabilities", F.lit(0.0), lambda t, p: t + p).alias("s"), F.array_min("probabilities").alias("low")).collect()
    assert all(abs(r.s - 1) < 1e-9 and r.low > 0 for r in sums) and made.columns == [*rest.columns, "probabilities"]
    assert loss(made) < loss(fitted.result_model(train, rest, ["a", "b", "c"], "y")) - 0.05


def test_poisson_and_seeds(planted):
    train, rest = planted.where("id < 2200"), planted.where("id >= 2200")
    plan = boosting.Boosting(kind="poisson", rounds=8, rate=0.5, seeds=(1, 2))
    made = boosting.boosted_scores(rest, boosting.boosted(train, ["a", "b", "c"], "goals", plan), "rate")
    flat = train.agg(F.avg("goals")).first()[0]
    loss = made.agg(F.avg(F.col("rate") - F.col("goals") * F.ln("rate")), F.avg(F.lit(flat) - F.col("goals") * F.ln(F.lit(flat)))).first()
    assert loss[0] < loss[1] - 0.01


def test_first_leaves_are_newton_steps(spark):
    rows = [(float(k % 2), c) for k, c in enumerate([0, 1, 0, 1, 0, 0, 0, 1] * 20)]
    df = spark.createDataFrame(rows, "x double, y int")
    plan = boosting.Boosting(classes=2, rounds=1, depth=1, rate=1.0, subsample=1.0, least=1, weights=(1.0, 2.0))
    model = boosting.boosted(df, ["x"], "y", plan)
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    w = np.where(y == 1, 2.0, 1.0)
    prior = w[y == 1].sum() / w.sum()
    assert model.start == pytest.approx([np.log(1 - prior), np.log(prior)])
    got = {r.x: r.probabilities[1] for r in boosting.boosted_scores(df, model).select("x", "probabilities").distinct().collect()}
    for v in (0.0, 1.0):
        own = x == v
        step = [(w[own] * ((y[own] == c) - q)).sum() / (w[own].sum() * q * (1 - q)) for c, q in ((0, 1 - prior), (1, prior))]
        m = np.array(model.start) + np.clip(step, -4, 4)
        assert got[v] == pytest.approx(np.exp(m[1]) / np.exp(m).sum(), abs=1e-9)
