"""Hand-computed values and edge cases."""

from datetime import datetime

from pyspark.sql import functions as F

from touchline import functions as fn
from touchline.operators import evaluation as ev
from touchline.operators import feedback as fb
from touchline.operators import fitted, joins, models
from touchline.operators import settlement as st
from touchline.operators import windows as win
from touchline.plans import more
from touchline.sources import readers


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scalars(spark):
    r = one(spark, fn.margin(F.lit(2.0), F.lit(3.5), F.lit(4.0)), ev.kelly(F.lit(0.5), F.lit(2.1), 1.0, 1.0), ev.kelly(F.lit(0.3), F.lit(1.5)), fn.implied(F.lit(1.0)), fn.season_code(F.lit(1993)), fn.status_code(F.lit("AET")), fn.status_code(F.lit("?")))
    assert abs(r[0] - 0.0357) < 1e-4 and abs(r[1] - (0.5 * 2.1 - 1) / 1.1) < 1e-9
    assert r[2] == 0 and r[3] is None and r[4] == "9394" and r[5] == "FT" and r[6] == "UNKNOWN"


def test_status_codes_are_those_of_the_reference(spark, small):
    """Reference: normalization/silver.py:13-18 (the map), :125 (what is no key of it is UNKNOWN); a raw LIVE is no key."""
    known = {"NS": "NS TBD PST", "LIVE": "1H HT 2H ET BT P", "FT": "FT AET PEN", "SUSP": "SUSP INT", "ABD": "ABD CANC", "POST": "POST", "UNKNOWN": "LIVE WO ft"}
    want = {raw: status for status, codes in known.items() for raw in codes.split()} | {None: "UNKNOWN"}
    made = spark.createDataFrame([(raw,) for raw in want], "raw string").select("raw", fn.status_code(F.col("raw")).alias("status"))
    assert {r.raw: r.status for r in made.collect()} == want
    codes = "NS TBD PST 1H HT 2H ET BT P LIVE FT AET PEN SUSP INT ABD CANC POST WO".split()
    got = more.status_codes(spark, small).collect()
    assert sorted(r.match_id for r in got) == sorted(r[0] for r in spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey").collect())
    assert {r.match_id % 19 for r in got} == set(range(19)) and all(r.status == want[codes[r.match_id % 19]] for r in got)


def test_value_bets(spark):
    df = spark.createDataFrame([(0.5, 0.25, 0.25, 1.9, 3.5, 4.5), (0.4, 0.3, 0.3, 3.0, 3.2, 2.6), (0.3, 0.3, 0.4, 3.0, 3.0, 2.0)], "p_h double, p_d double, p_a double, odds_h double, odds_d double, odds_a double")
    rows = ev.value_bets(df).collect()
    assert [r.selection for r in rows] == [2, 0, -1] and abs(rows[0].edge - 0.125) < 1e-9 and abs(rows[1].edge - 0.2) < 1e-9


def test_lost_bets_cost_their_stake(spark):
    df = spark.createDataFrame([(0.9, 0.05, 0.05, 2.0, 3.0, 4.0, "A")], "p_h double, p_d double, p_a double, odds_h double, odds_d double, odds_a double, result string")
    assert ev.betting_report(df).first().roi == -1.0 and ev.betting_report(df, compat=True).first().roi == 0.0


def test_dates(spark):
    df = spark.createDataFrame([("08/08/98",), ("08/08/1998",), ("1998-08-08",), ("x",)], "d string").select(fn.parse_day(F.col("d")).alias("d"))
    rows = [r.d for r in df.collect()]
    assert rows[0] == rows[1] == rows[2] and rows[3] is None


def test_strict_form_leaves_ties_out(spark):
    rows = [(1, 0, 1, datetime(2024, 1, 1), 7, 1.0), (2, 0, 1, datetime(2024, 1, 2), 7, 3.0), (3, 0, 1, datetime(2024, 1, 2), 7, 5.0), (4, 0, 1, datetime(2024, 1, 3), 7, 0.0)]
    df = spark.createDataFrame(rows, "match_id long, league int, season int, date timestamp, team long, gf double")
    got = {r.match_id: r.gf_strict_2 for r in win.strict_form(df, 2, ("gf",)).collect()}
    assert got == {1: None, 2: 1.0, 3: 1.0, 4: 4.0}


def test_elo_draw_counts_a_third(spark):
    df = spark.createDataFrame([(1, 0, 1, 2, datetime(2024, 1, 1), 1, 1), (2, 0, 1, 2, datetime(2024, 1, 8), 2, 0)], "match_id long, league int, home_team_id long, away_team_id long, date timestamp, home_goals int, away_goals int")
    rows = {r.match_id: r for r in models.elo_ratings(df.withColumn("date", F.col("date").cast("timestamp_ntz"))).collect()}
    e = 1 / (1 + 10 ** (-50 / 400))
    assert abs(rows[2].home_elo - (1500 + 32 * (1 / 3 - e))) < 1e-9


def test_validation(spark):
    df = spark.createDataFrame([(1, 5, 5, None, -1, 0, 5, 0, "")], "match_id long, home_team_id long, away_team_id long, date timestamp, home_goals int, away_goals int, ht_home_goals int, ht_away_goals int, home_team string")
    assert {r.issue for r in joins.validation_issues(df).collect()} == {"same_team", "missing_kickoff", "negative_goals", "impossible_score", "missing_team_name"}


def test_binomial_tail(spark):
    from math import comb

    want = sum(comb(20, i) * 0.3**i * 0.7 ** (20 - i) for i in range(9, 21))
    assert abs(one(spark, fb.binomial_tail(F.lit(9), F.lit(20), F.lit(0.3)))[0] - want) < 1e-9


def test_sources(spark, tmp_path):
    (tmp_path / "E0_9899.csv").write_text("Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR\nE0,15/08/98,A,B,1,0,H\nE0,16/08/98,C,D,,,\n")
    rows = readers.read_csv(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].league == "E0" and rows[0].season == "9899" and rows[0].home_goals == 1
    assert [r.code for r in readers.season_codes(spark, 1995).orderBy("year").collect()] == ["9394", "9495", "9596"]


def test_stream_windows_equal_batch(spark, small, tmp_path):
    from touchline.streaming.events import event_stream, windowed_prices

    batch = spark.read.parquet(f"{small}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windowed_prices(event_stream(spark, str(tmp_path / "in"), batch.schema, 10))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = windowed_prices(batch.withColumn("ts", F.col("ts").cast("timestamp")))
    assert spark.table("windows").exceptAll(want).count() == 0 and spark.table("windows").count() == want.count()


def test_coupon_leaves_unknown_markets_out(spark):
    df = spark.createDataFrame([(1, 0.5, 0.3, 0.2, "H", 2, 1, 0.6, None)], "match_id long, p_h double, p_d double, p_a double, result string, home_goals int, away_goals int, over25 double, corners int")
    lines = {"over25": (F.col("over25"), F.col("home_goals") + F.col("away_goals") > 2), "corners": (F.lit(0.7), F.col("corners") > 7)}
    legs = st.settled_legs(df, lines)
    assert {(r.market, r.pick, r.won) for r in legs.collect()} == {("1x2", "1", True), ("double_chance", "1X", True), ("over25", "yes", True)}
    assert st.coupon_scores(legs).first().score == "3/3"
    assert st.settled_legs(df.limit(0), lines).count() == 0


def test_registry_refuses_skipped_states(spark):
    log = [("m", "a", 1, "staging"), ("m", "a", 2, "production"), ("m", "b", 3, "production"), ("m", "c", 4, "staging"), ("m", "c", 5, "production"), ("m", "d", 6, "staging"), ("m", "a", 7, "production")]
    df = spark.createDataFrame([(m, v, at, at, to) for m, v, at, to in log], "model_id string, version string, at long, event_id long, to_status string")
    got = {r.version: r.status for r in st.registry_states(df).collect()}
    assert got == {"a": "archived", "b": "candidate", "c": "production", "d": "staging"}


def test_blend_falls_back(spark):
    r = one(spark, st.blend(F.lit(1.0), F.lit(2.0)), st.blend(F.lit(0.0), F.lit(2.0)), st.blend(F.lit(1.0), F.lit(None).cast("double")))
    assert abs(r[0] - 1.3) < 1e-9 and r[1] == 2.0 and r[2] == 1.0


def test_flip_moves_weak_predictions(spark):
    rows = [(i, 0.5, 0.2, 0.3, "A", "H", 0, 0.5) for i in range(60)] + [(60 + i, 0.3, 0.2, 0.5, "A", "A", 1, 0.5) for i in range(20)]
    df = spark.createDataFrame(rows, "match_id long, p_h double, p_d double, p_a double, result string, predicted string, correct int, confidence double")
    got = {r.match_id: r for r in st.flips(df, F.lit("all")).collect()}
    assert got[0].flip == "A" and abs(got[0].p_a - 0.45) < 1e-9 and got[70].flip is None and abs(got[70].p_a - 0.5) < 1e-9


def test_dixon_coles_finds_the_stronger_team(spark):
    import numpy as np

    rng, rows, rate = np.random.default_rng(3), [], {1: 2.4, 2: 1.2, 3: 0.6}
    for i in range(300):
        h, a = rng.choice([1, 2, 3], 2, replace=False)
        rows.append((i, 0, int(h), int(a), datetime(2024, 1, 1), int(rng.poisson(rate[h] * 1.3)), int(rng.poisson(rate[a]))))
    df = spark.createDataFrame(rows, "match_id long, league int, home_team_id long, away_team_id long, date timestamp, home_goals int, away_goals int")
    made = fitted.dixon_coles(df)
    got = {r.team: r for r in made.collect()}
    assert got[1].attack > got[2].attack > got[3].attack and 0.1 < got[1].home < 0.45 and abs(got[1].attack - got[2].attack - np.log(2)) < 0.25
    ask = spark.createDataFrame([(1, 0, 1, 3), (2, 0, 9, 3), (3, 5, 1, 3)], "match_id long, league int, home_team_id long, away_team_id long")
    rates = {r.match_id: r for r in fitted.goal_rates(ask, made).collect()}
    assert 2.3 < rates[1].lh < 4 and rates[2].lh < rates[1].lh and abs(rates[3].lh - 1.43) < 1e-9
    assert fitted.dixon_coles(df.limit(5)).count() == 0


def test_calibration_mends_scores(spark):
    rows = [(i / 1000, int(((i * 37) % 100) / 100 < (i / 1000) ** 2)) for i in range(1, 1000)]
    df = spark.createDataFrame(rows, "s double, y int")
    iso = [r.isotonic for r in fitted.isotonic(df, df, "y", "s").orderBy("s").collect()]
    assert all(b >= a for a, b in zip(iso, iso[1:], strict=False))
    per = {r.method: r for r in fitted.best_calibration(df, df, "y", "s").collect()}
    assert not per["none"].chosen and sum(r.chosen for r in per.values()) == 1 and per["beta"].log_loss < per["none"].log_loss


def test_boosted_trees_learn_a_step(spark):
    df = spark.createDataFrame([(i, float(i % 10), int(i % 10 > 6)) for i in range(200)], "match_id long, f double, y int")
    got = {r.f: r.probabilities[1] for r in fitted.result_model(df, df, ["f"], "y", "trees").collect()}
    assert got[9.0] > 0.8 and got[1.0] < 0.2


def test_binomial_tail_is_exact_at_every_size(spark):
    from math import exp, lgamma, log

    term = lambda i, n, p: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p))
    cases = [(120, 201, 0.55), (825, 1250, 0.6), (3, 250, 0.5), (249, 250, 0.5), (250, 250, 0.5), (1, 5, 0.3), (601_500, 1_000_000, 0.6)]
    got = one(spark, *[fb.binomial_tail(F.lit(k), F.lit(n), F.lit(p)) for k, n, p in cases])
    for value, (k, n, p) in zip(got, cases, strict=True):
        want = sum(term(i, n, p) for i in range(k, n + 1))
        assert abs(value - want) < 1e-6 * want
    assert list(one(spark, fb.binomial_tail(F.lit(0), F.lit(9), F.lit(0.5)), fb.binomial_tail(F.lit(10), F.lit(9), F.lit(0.5)), fb.binomial_tail(F.lit(2), F.lit(9), F.lit(0.0)))) == [1.0, 0.0, 0.0]


def test_patterns_of_every_kind(spark):
    rows = []
    for i in range(400):  # team 7 errs at home and away, in April and over four goals; sure picks err too
        bad = i % 4 == 0
        home, away = ((7, 100 + i) if i % 8 else (100 + i, 7)) if bad else (500 + i, 1000 + i)
        rows.append((home, away, int(bad), "D" if bad else "H", 5 if bad else 1, 1, 0.75 if bad else 0.6, datetime(2024, 4 if bad else 5, 1), 0 if bad else int(i % 10 > 0)))
    df = spark.createDataFrame(rows, "home_team_id long, away_team_id long, league int, result string, home_goals int, away_goals int, confidence double, date timestamp, correct int")
    got = {(r.kind, r.value): r for r in fb.patterns(df).collect()}
    assert set(got) == {("league", "1"), ("team", "7"), ("result", "D"), ("goals", "4+"), ("confidence", "0.7-0.9"), ("month", "4")}
    assert got["team", "7"].n == 100 and got["team", "7"].errors == 100 and got["team", "7"].severity == 1.0
    assert fb.patterns(df.limit(0)).count() == 0


def test_rates_are_refitted_each_year(spark):
    from datetime import timedelta

    import numpy as np

    rng, rows, first = np.random.default_rng(5), [], datetime(2020, 1, 1)
    for i in range(1200):  # team 1 scores much in the first year only; team 9 comes in the second
        h, a = rng.choice([1, 2, 3] if i < 400 else [1, 2, 9], 2, replace=False)
        goals = lambda t, i=i: int(rng.poisson(4.0 if t == 1 and i < 400 else 2.5 if t == 9 else 0.6))
        rows.append((i, 0, int(h), int(a), first + timedelta(days=i), goals(h), goals(a)))
    df = spark.createDataFrame(rows, "match_id long, league int, home_team_id long, away_team_id long, date timestamp, home_goals int, away_goals int")
    asked = df.where("match_id >= 400")  # periods from day 400, 765 and 1130 on
    got = {r.match_id: r for r in fitted.rolling_rates(df, asked).collect()}
    assert len(got) == 800
    of = lambda team, a, b: np.mean([got[i].lh for i, _, h, *_ in rows if h == team and a <= i < b])
    assert of(1, 400, 765) > 2.5 > 1.6 > of(1, 1130, 1200)
    assert of(9, 765, 1200) > of(1, 1130, 1200) + 0.7
    for lo, hi in ((400, 765), (765, 1130), (1130, 1200)):  # each period by brute force
        want = {r.match_id: r for r in fitted.goal_rates(df.where(f"match_id >= {lo} and match_id < {hi}"), fitted.dixon_coles(df.where(f"match_id < {lo}"))).collect()}
        assert all(abs(got[k].lh - r.lh) < 1e-9 and abs(got[k].la - r.la) < 1e-9 for k, r in want.items())


def test_elo_streams_batches(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        h, a = rng.choice(6, 2, replace=False)
        rows.append((i, i % 3, int(h), int(a), datetime(2024, 1, 1 + i // 30), int(rng.integers(4)), int(rng.integers(4))))
    df = spark.createDataFrame(rows, "match_id long, league int, home_team_id long, away_team_id long, date timestamp_ntz, home_goals int, away_goals int").repartition(5)
    made = models.elo_ratings(df)
    assert "MapInArrow" in made._jdf.queryExecution().toString() and "FlatMapGroups" not in made._jdf.queryExecution().toString()
    want, rating = {}, {}
    for i, league, h, a, _, hg, ag in rows:
        x, y = rating.get((league, h), 1500.0), rating.get((league, a), 1500.0)
        want[i] = (x, y)
        e = 1 / (1 + 10 ** (-(x - y + 50) / 400))
        s, t = (1, 0) if hg > ag else (1 / 3, 1 / 3) if hg == ag else (0, 1)
        rating[league, h], rating[league, a] = x + 32 * (s - e), y + 32 * (t - (1 - e))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # batches end within and across leagues
    try:
        got = {r.match_id: (r.home_elo, r.away_elo) for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == 600 and all(np.allclose(got[i], want[i]) for i in want)


def test_market_checks_mix_and_round_to_the_last_bit(spark):
    import duckdb

    from touchline.plans.queries import sql_round

    rows = [(i / 20, j / 20) for i in range(21) for j in range(21)]
    df = spark.createDataFrame(rows, "t double, g double").where("t > 0 and g > 0")
    assert all(r.b == 0.7 * r.t + 0.3 * r.g for r in df.select("t", "g", st.blend(F.col("t"), F.col("g")).alias("b")).collect())
    made = spark.range(20_000).select((0.2 + F.col("id") / 12800.0).alias("x")).select("x", sql_round("x", 9).alias("r")).collect()
    said = duckdb.sql("select 0.2e0 + i / 12800.0e0 x, round(0.2e0 + i / 12800.0e0, 9) r from range(20000) t(i) order by i").fetchall()
    assert [tuple(r) for r in made] == said


def test_checked_markets_keep_probabilities_that_sum_to_one(spark):
    df = spark.range(2000).select((0.1 + F.col("id") / 7919.0).alias("p_h"), (0.1 + F.col("id") / 6007.0).alias("p_d")).withColumn("p_a", 1 - F.col("p_h") - F.col("p_d"))
    assert st.normalised(df, 1e-12).exceptAll(df).count() == 0
    half = st.normalised(df.select(*[(F.col(c) / 2).alias(c) for c in df.columns]), 1e-12)
    assert half.where("abs(p_h + p_d + p_a - 1) > 1e-12").count() == 0


def _joined_rows(plan):
    """The most rows that a join of an executed plan gave."""
    name = plan.nodeName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(k) for k in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows").get().value() if "Join" in name else 0
    return max([own, *map(_joined_rows, inner)])


def test_near_results_join_days_and_not_rows(spark):
    day = lambda k: datetime(2020, 1, 1 + k % 3, k % 5)
    results = [(1 + k % 2, 2 - k % 2, day(k), k % 4, k % 3, k % 7 % 3) for k in range(600)]
    asked = [(k % 590, 1 + k % 2, 2 - k % 2, day(k * 7)) for k in range(600)]  # ten ids asked twice
    made = joins.results_near(spark.createDataFrame(asked, "request_id int, home int, away int, day timestamp"), spark.createDataFrame(results, "home int, away int, day timestamp, home_goals int, away_goals int, priority int"), days=1)
    both = [(h, a, p, False, d, hg, ag) for h, a, d, hg, ag, p in results] + [(a, h, p, True, d, ag, hg) for h, a, d, hg, ag, p in results]
    want = {}
    for k, h, a, d in asked:
        gap = lambda t, d=d: abs((t.date() - d.date()).days)
        want[k] = min([(p, gap(t), sw, t, hg, ag) for x, y, p, sw, t, hg, ag in both if (x, y) == (h, a) and gap(t) <= 1] + ([want[k]] if k in want else []))
    got = made.collect()
    assert len(got) == 590 and all(want[r.request_id] == (r.priority, abs((r.result_day.date() - r.day.date()).days), r.swapped, r.result_day, r.home_goals, r.away_goals) for r in got)
    assert _joined_rows(made._jdf.queryExecution().executedPlan()) <= 600
