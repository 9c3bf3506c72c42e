"""Fitted models against dense or plain versions of the same fit."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import adjusting, estimation, fitted
from touchline.plans import fits
from touchline.plans.matches import matches, predictions


@pytest.fixture(scope="module")
def played(spark, small):
    return matches(spark, small).persist()


def test_stats_equal_a_dense_solution(spark, small):
    rows = fits.stat_rows(spark, small).persist()
    models = estimation.stat_models(rows, fits.FORM)
    pdf = rows.toPandas()
    some = pdf[estimation.STATS].notna().any(axis=1)
    x = np.column_stack([np.ones(some.sum()), pdf.loc[some, fits.FORM].astype(float).fillna(0)])
    pull = np.diag([0.0] + [1e-3 * len(x)] * len(fits.FORM))
    assert set(models.coefficients) == set(estimation.STATS)
    filled = estimation.stats_filled(rows, models).toPandas().set_index("match_id")
    every = np.column_stack([np.ones(len(pdf)), pdf[fits.FORM].astype(float).fillna(0)])
    for t, beta in models.coefficients.items():
        y = pdf.loc[some, t].astype(float)
        dense = np.linalg.solve(x.T @ x + pull, x.T @ y.fillna(y.mean()))
        np.testing.assert_allclose(beta, dense, rtol=1e-6, atol=1e-8)
        said = np.round(np.maximum(every @ dense, 0))
        want = np.where(pdf[t].notna(), pdf[t].astype(float), np.minimum(said, 3) if t.endswith("red") else said)
        assert (filled.loc[pdf.match_id, t].to_numpy() == want).all(), t
    assert filled.data_completeness.eq(0.75).all() and rows.where("home_shots is null").count() > 0


def test_stats_without_enough_rows(spark):
    df = spark.createDataFrame([(k, float(k), k if k % 2 else None) for k in range(40)], "match_id long, f double, home_shots int")
    assert estimation.stat_models(df, ["f"]).coefficients == {} and estimation.stats_filled(df, estimation.stat_models(df, ["f"])).columns == df.columns
    assert set(estimation.stat_models(df, ["f"], least=10, least_known=20).coefficients) == {"home_shots"}
    assert estimation.stat_models(df, ["f"], least=10, least_known=21).coefficients == {} and estimation.stat_models(df.limit(0), ["f"]).coefficients == {}


def test_global_strengths_equal_a_dense_fit_of_all_matches(played):
    made = {r.team: r for r in estimation.global_strengths(played, top=30).collect()}
    pdf = played.select("home_team_id", "away_team_id", "home_goals", "away_goals").toPandas()
    named = pdf[["home_team_id", "away_team_id"]].map(lambda t: t if t in made else -1)
    names, at = np.unique(named.to_numpy().T.ravel(), return_inverse=True)
    h, a = np.split(at, 2)
    beta, k = fitted.poisson_strengths(h, a, pdf.home_goals.to_numpy(), pdf.away_goals.to_numpy(), len(names)), len(names)
    got = np.array([[made[t].attack, made[t].defence] for t in names])
    np.testing.assert_allclose(got, np.stack([beta[2 : 2 + k], beta[2 + k :]], axis=1), atol=1e-6)
    one = made[names[0]]
    np.testing.assert_allclose((one.base, one.home), beta[:2], atol=1e-6)
    rates = np.exp(beta[0] + beta[1] + beta[2 + h] - beta[2 + k + a]), np.exp(beta[0] + beta[2 + a] - beta[2 + k + h])
    assert one.rho == fitted.low_score_rho(*rates, pdf.home_goals.to_numpy(), pdf.away_goals.to_numpy()) and one.n == len(pdf)
    assert estimation.global_strengths(played.limit(0)).count() == 0


def test_mixture_is_the_least_of_a_fine_grid(spark, played):
    rows = fits.three_models(predictions(played)).persist()
    w = estimation.mixture_weights(rows, ["odds", "flat", "sharp"])
    p = np.maximum(np.array(rows.select("odds", "flat", "sharp").collect()), 1e-15)
    loss = lambda v: -np.log(p @ np.array(v)).mean()
    assert w.min() >= 0 and w.sum() == pytest.approx(1)
    assert loss(w) <= min(loss((a / 100, b / 100, 1 - a / 100 - b / 100)) for a, b in itertools.product(range(101), repeat=2) if a + b <= 100) + 1e-12
    near = [np.maximum(w + 1e-4 * np.array(v), 0) for v in itertools.permutations((1, -1, 0))]
    assert all(loss(w) <= loss(v / v.sum()) + 1e-12 for v in near)
    planted = spark.createDataFrame([(0.9, 0.2), (0.9, 0.1), (0.1, 0.8)], "a double, b double")
    v = estimation.mixture_weights(planted, ["a", "b"])
    fine = np.linspace(0, 1, 2_000_001)
    q = np.array([(0.9, 0.2), (0.9, 0.1), (0.1, 0.8)])
    assert v[0] == pytest.approx(fine[np.argmin(-np.log(q[:, :1] * fine + q[:, 1:] * (1 - fine)).mean(axis=0))], abs=1e-6)


def test_temperature_is_the_least_of_a_fine_grid(spark):
    rng = np.random.default_rng(3)
    q = rng.dirichlet((2, 2, 2), 3000)
    y = (q.cumsum(axis=1) > rng.random((3000, 1))).argmax(axis=1)
    p = q**1.8 / (q**1.8).sum(axis=1, keepdims=True)
    heat = estimation.temperature(spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(p, y, strict=True)], "h double, d double, a double, happened int"), ["h", "d", "a"], "happened")
    assert 1.5 < heat < 2.1

    def loss(t):
        z = np.log(p) / t
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean()

    fine = np.exp(np.linspace(np.log(heat) - 0.01, np.log(heat) + 0.01, 2001))
    assert heat == pytest.approx(fine[np.argmin([loss(t) for t in fine])], abs=1e-4) and all(loss(heat) <= loss(t) + 1e-12 for t in np.geomspace(0.05, 20, 400))


def test_classes_are_calibrated_only_where_that_helps(spark):
    rng = np.random.default_rng(4)
    q = rng.dirichlet((2, 2, 2), 6000)
    y = (q.cumsum(axis=1) > rng.random((6000, 1))).argmax(axis=1)
    sharp = q**2.5 / (q**2.5).sum(axis=1, keepdims=True)
    for p, helps in ((sharp, True), (q, False)):
        df = spark.createDataFrame([(k, *map(float, r), int(c)) for k, (r, c) in enumerate(zip(p, y, strict=True))], "id long, h double, d double, a double, y int")
        made = adjusting.calibrated_classes(df.where("id < 4000"), df.where("id >= 4000"), "y", ["h", "d", "a"], least_error=0.05)
        rows = made.orderBy("id").collect()
        got = np.array([(r.h, r.d, r.a) for r in rows])
        assert {r.calibrated for r in rows} == {helps} and len(rows) == 2000 and np.allclose(got.sum(axis=1), 1)
        brier = lambda x, y=y: ((x - np.eye(3)[y[4000:]]) ** 2).sum(axis=1).mean()
        assert brier(got) < brier(p[4000:]) - 0.02 if helps else np.allclose(got, p[4000:])


def test_rows_that_calibrate_classes_are_computed_once(spark):
    rng = np.random.default_rng(5)
    rows = [(k, *map(float, r), int(rng.integers(3))) for k, r in enumerate(rng.dirichlet((2, 2, 2), 400))]
    df, seen = spark.createDataFrame(rows, "id long, h double, d double, a double, y int"), spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    cal = df.where("id < 300").withColumn("h", F.udf(told, "double")("h"))
    made = adjusting.calibrated_classes(cal, df.where("id >= 300"), "y", ["h", "d", "a"])
    assert made.count() == 100 and seen.value == 300


def test_gram_of_the_statistics_is_summed_by_task(spark):
    """Each task sends one row a cell, whatever its rows."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(3000, 1)), rng.integers(0, 9, 3000)
    df = spark.createDataFrame([(1.0, float(a), None if k % 3 == 0 else float(b)) for k, (a, b) in enumerate(zip(x[:, 0], y, strict=True))], "c double, x double, y double").repartition(3)
    got = df.mapInArrow(estimation._products(2), "at int, part double").toPandas()
    assert len(got) == 3 * 2 * 4
    a, seen = np.column_stack([np.ones(3000), x]), (np.arange(3000) % 3 != 0).astype(float)
    assert np.allclose(got.groupby("at")["part"].sum().to_numpy().reshape(2, 4), a.T @ np.column_stack([a, y * seen, seen]))
