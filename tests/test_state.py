"""Streams of keyed state and lifecycles, run in micro-batches, and exact row numbers."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.operators import fold_models, ordering
from touchline.operators import reports as rp
from touchline.operators import windows as win
from touchline.plans.matches import matches, predictions
from touchline.streaming import state as st


@pytest.fixture(scope="module")
def long(spark, small):
    return win.long_view(matches(spark, small)).select("league", "team", F.col("date").cast("timestamp").alias("date"), "match_id", "gf", "ga", "pts").persist()


def rows_of(df):
    names = [f"{c}_{n}" for n in (5, 10) for c in ("gf", "ga", "pts")]
    return {(r.league, r.team, r.match_id): tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) for v in (r[c] for c in names)) for r in df.collect()}


def whole(long):
    w = win.W.partitionBy("league", "team").orderBy("date", "match_id")
    return rows_of(long.withColumns({f"{c}_{n}": F.avg(c).over(w.rowsBetween(-n, -1)) for n in (5, 10) for c in ("gf", "ga", "pts")}))


def test_form_from_the_state_is_form_from_everything(long):
    want = whole(long)
    cuts = ["1994-06-01", "1996-01-01"]
    first, second = long.where(f"date < '{cuts[0]}'"), long.where(f"date >= '{cuts[0]}' and date < '{cuts[1]}'")
    state = st.team_state(first)
    got = rows_of(st.advanced(state, second))
    assert got == {k: want[k] for k in got} and len(got) == second.count() > 0
    state = st.team_state(state.unionByName(second.select("league", "team", *st._row())))
    got = rows_of(st.advanced(state, long.where(f"date >= '{cuts[1]}'")))
    assert got == {k: want[k] for k in got} and state.groupBy("league", "team").count().where("count > 30").count() == 0
    with pytest.raises(ValueError):
        st.advanced(state, second, (40,))


def test_form_stream_equals_windows(spark, long, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKS)
    seen = long.where("date >= '1996-01-01'").select("league", "team", *st._row())
    for k, (a, b) in enumerate((("1996", "1997"), ("1997", "1998"), ("1998", "2010"))):
        seen.where(f"date >= '{a}-01-01' and date < '{b}-01-01'").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    made = []
    query = st.form_stream(stream, st.team_state(long.where("date < '1996-01-01'"))).writeStream.foreachBatch(lambda df, k: made.append(rows_of(df))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(240)
    want, got = whole(long), {k: v for batch in made for k, v in batch.items()}
    assert len([b for b in made if b]) == 3 and got == {k: want[k] for k in got} and len(got) == seen.count()


def test_lifecycle_settles_all_and_expires_what_has_no_result(spark, tmp_path):
    t = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    p_schema = "prediction_id string, fixture_id long, prediction_time timestamp, p_h double, p_d double, p_a double"
    r_schema = "fixture_id long, result_time timestamp, home_goals int, away_goals int"
    p_batches = [[("1_KO", 1, t(0), 0.5, 0.3, 0.2), ("2_KO", 2, t(0), 0.2, 0.3, 0.5)], [("1_LIVE45", 1, t(45), 0.7, 0.2, 0.1), ("3_KO", 3, t(50), 0.4, 0.3, 0.3)], [("9_KO", 9, t(1000), 0.4, 0.3, 0.3)], [("9_LATER", 9, t(1400), 0.4, 0.3, 0.3)]]
    r_batches = [[(7, t(1), 0, 0)], [(1, t(100), 2, 0)], [(3, t(160), 1, 1), (9, t(1100), 0, 1)], [(8, t(1500), 0, 0)]]
    for name, schema, batches in (("p", p_schema, p_batches), ("r", r_schema, r_batches)):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k}")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    made = []
    st.lifecycle(read("p", p_schema), read("r", r_schema)).writeStream.foreachBatch(lambda df, k: made.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(240)
    got = {r.prediction_id: r for r in made}
    assert len(made) == len(got) and {k: (r.status, r.outcome) for k, r in got.items() if k != "9_LATER"} == {"1_KO": ("settled", "H"), "1_LIVE45": ("settled", "H"), "2_KO": ("expired", None), "3_KO": ("settled", "D"), "9_KO": ("settled", "A")}
    assert got["1_LIVE45"].log_loss == pytest.approx(-math.log(0.7)) and got["2_KO"].log_loss is None
    flat = lambda schema, batches: spark.createDataFrame([r for b in batches for r in b], schema)
    batch = {r.prediction_id: (r.status, r.outcome) for r in st.lifecycle(flat(p_schema, p_batches), flat(r_schema, r_batches)).collect()}
    assert {k: v for k, v in batch.items() if k != "9_LATER"} == {k: (r.status, r.outcome) for k, r in got.items() if k != "9_LATER"}


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    folder = f"{tmp_path}/predictions"
    df = lambda *rows: spark.createDataFrame(rows, "prediction_id string, at long, payload string")
    rows = lambda: sorted(tuple(r) for r in st.snapshot(spark, folder).collect())
    assert st.snapshot(spark, folder) is None
    put = lambda k, *x: st.upsert_batch(df(*x), k, folder, ["prediction_id"], "at")
    put(0, ("a", 1, "x"), ("b", 1, "x"), ("a", 2, "y"))
    assert rows() == [("a", 2, "y"), ("b", 1, "x")]
    put(1, ("a", 1, "old"), ("b", 1, "same time"), ("c", 5, "z"))
    after = rows()
    assert after == [("a", 2, "y"), ("b", 1, "same time"), ("c", 5, "z")]
    put(1, ("a", 1, "old"), ("b", 1, "same time"), ("c", 5, "z"))
    put(0, ("a", 9, "replayed"))
    assert rows() == after and st.applied(spark, folder) == [0, 1]
    df(("a", 3, "half")).write.parquet(f"{folder}/v=2")  # written, but not counted: the job was lost
    assert rows() == after
    put(2, ("a", 3, "whole"))
    assert rows()[0] == ("a", 3, "whole")
    df(("d", 1, "s")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("prediction_id string, at long, payload string").parquet(f"{tmp_path}/in")
    for _ in range(2):
        st.upsert_stream(stream, f"{tmp_path}/other", f"{tmp_path}/cp", ["prediction_id"], "at").awaitTermination(120)
    assert [tuple(r) for r in st.snapshot(spark, f"{tmp_path}/other").collect()] == [("d", 1, "s")]


def test_row_numbers_and_folds(spark):
    df = spark.range(0, 1000, 1, 7).select((F.xxhash64("id") % 1_000_003).alias("k"), "id", F.lit("clash").alias("row"))
    made = [(r.k, r.id) for r in ordering.row_numbers(df, [F.col("k"), F.col("id")]).orderBy("row").collect()]
    assert made == sorted(made) and len(made) == 1000
    numbered = ordering.row_numbers(df, [F.col("id")])
    assert [r.row for r in numbered.orderBy("row").collect()] == list(range(1000))
    want, i = set(), 0
    while i + 300 + 100 <= 1000:
        want |= {(i // 150, "train", r) for r in range(i, i + 300)} | {(i // 150, "test", r) for r in range(i + 300, i + 400)}
        i += 150
    got = [(r.fold, r.part, r.row) for r in ordering.row_folds(numbered, 300, 100, 150).collect()]
    assert set(got) == want and len(got) == len(want)
    assert ordering.row_folds(numbered.where("row < 50"), 300, 100, 150).count() == 0 and ordering.row_numbers(df.limit(0), [F.col("id")]).count() == 0
    seasons = spark.createDataFrame([(s,) for s in range(2000, 2006)], "season int")
    got = {(r.fold, r.part, r.season) for r in ordering.season_folds(seasons, 2003, 2004, 2).collect()}
    assert got == {(2003, "test", 2003), (2003, "train", 2002), (2003, "train", 2001), (2004, "test", 2004), (2004, "train", 2003), (2004, "train", 2002)}


def test_models_of_folds_equal_a_plain_fit(spark, small):
    p = predictions(matches(spark, small)).withColumn("y", F.when(F.col("result") == "H", 0).when(F.col("result") == "D", 1).otherwise(2))
    folds = rp.walk_forward(p, "1996-01-01", n=2).persist()
    made = fold_models.fitted_folds(folds, ["odds_h", "odds_d", "odds_a"], "y").persist()
    report = {(r.fold, r.model): r for r in fold_models.fold_report(made).collect()}
    for fold in (0, 1):
        pdf = folds.where(F.col("fold") == fold).toPandas()
        part = {k: g for k, g in pdf.groupby("part")}
        x = {k: np.column_stack([np.ones(len(g)), g[["odds_h", "odds_d", "odds_a"]]]) for k, g in part.items()}
        w = np.zeros((4, 3))
        one = np.eye(3)[part["train"].y]
        for _ in range(60):  # Newton on all weights; the flat direction (equal shifts of the classes) gets a small pull
            z = x["train"] @ w
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            bend = np.zeros((12, 12))
            for a in range(3):
                for b in range(3):
                    bend[4 * a : 4 * a + 4, 4 * b : 4 * b + 4] = (x["train"] * (q[:, a] * ((a == b) - q[:, b]))[:, None]).T @ x["train"]
            w += np.linalg.solve(bend + 1e-9 * np.eye(12), (x["train"].T @ (one - q)).T.ravel()).reshape(3, 4).T

        def probabilities(k, w=w, x=x):
            q = np.exp(x[k] @ w)
            return q / q.sum(axis=1, keepdims=True)

        def loss(q, y, heat=1.0):
            h = q ** (1 / heat)
            h /= h.sum(axis=1, keepdims=True)
            return -np.log(h[np.arange(len(y)), y]).mean()

        got = {r.match_id: r for r in made.where(F.col("fold") == fold).collect()}
        np.testing.assert_allclose([got[k].raw for k in part["validate"].match_id], probabilities("validate"), atol=1e-4)
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 4001))
        heat = grid[np.argmin([loss(probabilities("calibrate"), part["calibrate"].y.to_numpy(), t) for t in grid])]
        assert report[fold, "raw"].temperature == pytest.approx(heat, rel=0.01)
        y = part["validate"].y.to_numpy()
        assert report[fold, "raw"].log_loss == pytest.approx(loss(probabilities("validate"), y), abs=1e-4) and report[fold, "raw"].n == len(y)
        assert report[fold, "calibrated"].log_loss == pytest.approx(loss(probabilities("validate"), y, heat), abs=1e-3)
