"""Ratings, fits and feedback against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import bound, poisson_pmf
from touchline.operators import estimation, decisions, features, feedback, fitted, matching, models
from touchline.operators import windows as win
from touchline.plans.matches import matches, predictions


@pytest.fixture(scope="module")
def played(spark, small):
    return matches(spark, small).cache()


@pytest.fixture(scope="module")
def rows(played):
    return sorted(played.collect(), key=lambda r: (r.date, r.match_id))


def plain_elo(rows, k=32, edge=50, draw=1 / 3, winner=False, digits=None):
    """match_id to the six ratings before it, by one loop over all matches."""
    r, out = {}, {}
    e = lambda d: 1 / (1 + 10 ** (-d / 400))
    for m in rows:
        h, a = r.setdefault((m.league, m.home_team_id), [1500.0] * 3), r.setdefault((m.league, m.away_team_id), [1500.0] * 3)
        out[m.match_id] = (h[0], a[0], h[1], h[2], a[1], a[2])
        own = -edge if winner and m.away_goals > m.home_goals else edge
        p, s = e(h[0] - a[0] + own), (1 if m.home_goals > m.away_goals else draw if m.home_goals == m.away_goals else 0)
        t = 1 if m.away_goals > m.home_goals else draw if m.home_goals == m.away_goals else 0
        x, y = min(m.home_goals / 3, 1) - e(h[1] - a[2] + edge), min(m.away_goals / 3, 1) - e(a[1] - h[2] - edge)
        h[0], a[0] = h[0] + k * (s - p), a[0] + k * (t - 1 + p)
        h[1], a[1], h[2], a[2] = h[1] + k * x, a[1] + k * y, h[2] - k * y, a[2] - k * x
        if digits is not None:
            h[:], a[:] = [round(v, digits) for v in h], [round(v, digits) for v in a]
    return out


def test_elo_of_all_matches(played, rows):
    want = plain_elo(rows)
    got = models.elo_ratings(played).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.home_elo, r.away_elo, r.home_att, r.home_def, r.away_att, r.away_def) == pytest.approx(want[r.match_id], abs=1e-9)
    rules = {"half_draw": models.Elo(draw=0.5), "slow": models.Elo(k=20.0, draw=0.5), "reversed": models.Elo(edge=-50.0, draw=0.5, digits=0), "winner": models.Elo(winner_edge=True, draw=0.5)}
    plain = {"half_draw": plain_elo(rows, 32, 50, 0.5), "slow": plain_elo(rows, 20, 50, 0.5), "reversed": plain_elo(rows, 32, -50, 0.5, digits=0), "winner": plain_elo(rows, 32, 50, 0.5, winner=True)}
    made = models.elo_by_rules(played, rules).collect()
    assert len(made) == 4 * len(rows)
    for r in made:
        assert (r.home_elo, r.away_elo, r.home_att, r.home_def, r.away_att, r.away_def) == pytest.approx(plain[r.rule][r.match_id], abs=1e-9), r.rule


def test_elo_goes_on_from_a_snapshot(played, rows):
    want, cut = plain_elo(rows), "season < 1998"
    state = models.elo_state(played.where(cut))
    got = models.elo_ratings(played.where(f"not ({cut})"), seeds=state).collect()
    assert got and all(r.home_elo == pytest.approx(want[r.match_id][0], abs=1e-9) and r.away_def == pytest.approx(want[r.match_id][5], abs=1e-9) for r in got)
    again = models.elo_state(played.where(f"not ({cut})"), seeds=state).collect()
    assert np.allclose(np.array(sorted(map(tuple, again))), np.array(sorted(map(tuple, models.elo_state(played).collect()))), rtol=0, atol=1e-9)


def test_elo_probabilities_and_opponents(played, rows):
    want = plain_elo(rows)
    rated = models.elo_ratings(played)
    rate = models.fitted_draw_rate(played)
    assert rate == pytest.approx(np.mean([r.home_goals == r.away_goals for r in rows]))
    for r in models.elo_1x2(rated, rate).collect():
        gap = want[r.match_id][0] - want[r.match_id][1]
        d = min(max(min(max(rate, 0.18), 0.34) * math.exp(-abs(gap) / 350), 0.05), 0.45)
        share = 1 / (1 + 10 ** (-(gap + 50) / 400))
        assert (r.p_h, r.p_d, r.p_a) == pytest.approx(((1 - d) * share, d, (1 - d) * (1 - share)), abs=1e-9)
    seen, strength = {}, {}
    for m in rows:
        for own, opp in ((m.home_team_id, want[m.match_id][1]), (m.away_team_id, want[m.match_id][0])):
            past = seen.setdefault((m.league, own), [])
            strength[m.match_id, own] = np.mean(past[-10:]) if past else None
            past.append(opp)
    for r in models.opponent_strength(rated).collect():
        assert r.opp_strength == (None if strength[r.match_id, r.team] is None else pytest.approx(strength[r.match_id, r.team], abs=1e-9))


def test_planted_bias_is_found(spark):
    rng = np.random.default_rng(42)
    made = []
    for k in range(200):
        bias = k < 100
        h = rng.uniform(0.1, 0.3) if bias else 0.8
        made.append((k, 1 if bias else 2, 10 + k % 7, 30 + k % 7, __import__("datetime").datetime(2020, 1 + k % 12, 1), 2 if bias else 3, 0, h, (1 - h) / 2 - 0.01, (1 - h) / 2 + 0.01, "H"))
    recs = feedback.records(spark.createDataFrame(made, "match_id long, league int, home_team_id long, away_team_id long, date timestamp, home_goals int, away_goals int, p_h double, p_d double, p_a double, result string"))
    found = {(r.kind, r.value): r for r in feedback.patterns(recs).collect()}
    league = found["league", "1"]
    assert league.severity > 0.2 and league.n == 100 and ("league", "2") not in found
    tail = sum(math.comb(100, i) * 0.5**100 for i in range(league.errors, 101))
    assert league.p_value == pytest.approx(tail, abs=1e-6) and league.expected == pytest.approx(0.5)
    plan = decisions.correction_plan(feedback.patterns(recs)).collect()
    assert any(p.kind == "league" and p.action == "downweight" and p.expected_gain == pytest.approx(league.severity * 0.1) for p in plan)


@pytest.mark.parametrize(("k", "n", "p"), [(3, 20, 0.1), (120, 201, 0.55), (825, 1250, 0.6), (700, 1250, 0.6), (2, 3, 0.5)])
def test_binomial_tail(spark, k, n, p):
    from fractions import Fraction

    q = Fraction(p)
    want = float(sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k, n + 1)))
    got = spark.range(1).select(feedback.binomial_tail(F.lit(k), F.lit(n), F.lit(p))).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def test_fits(spark, played):
    made = estimation.global_strengths(played, top=30).collect()
    assert len(made) == 31 and {r.team for r in made} >= {-1} and len({(r.base, r.home, r.rho) for r in made}) == 1
    one = spark.range(1).select(*[c.alias(k) for k, c in fitted.closed_form_1x2(F.lit(1.4), F.lit(1.1), F.lit(-0.1)).items()]).first()
    grid = np.outer([math.exp(-1.4) * 1.4**i / math.factorial(i) for i in range(11)], [math.exp(-1.1) * 1.1**i / math.factorial(i) for i in range(11)])
    total = grid.sum()
    grid[0, 0], grid[0, 1], grid[1, 0], grid[1, 1] = grid[0, 0] * 1.154, grid[0, 1] * (1 - 0.14), grid[1, 0] * (1 - 0.11), grid[1, 1] * 1.1
    assert grid.sum() == pytest.approx(total)
    assert (one.p_h, one.p_d, one.p_a) == pytest.approx((np.tril(grid, -1).sum() / total, np.trace(grid) / total, np.triu(grid, 1).sum() / total), abs=1e-12)
    p = predictions(played).withColumn("y", (F.col("result") == "H").cast("int"))
    rows = fitted.best_calibration(p.where("season < 1997"), p.where("season >= 1997"), "y", "p_h").collect()
    losses = {r.method: r.log_loss for r in rows}
    late = p.where("season >= 1997").select("y", "p_h").collect()
    assert losses["none"] == pytest.approx(np.mean([-math.log(r.p_h if r.y else 1 - r.p_h) for r in late])) and sum(r.chosen for r in rows) == 1
    kinds = p.withColumn("k", F.when(F.col("result") == "H", 0).when(F.col("result") == "D", 1).otherwise(2))
    probs = np.array([r.probabilities for r in fitted.result_model(kinds.where("season < 1997"), kinds.where("season >= 1997"), ["odds_h", "odds_d", "odds_a"], "k").collect()])
    assert probs.shape[1] == 3 and np.allclose(probs.sum(axis=1), 1) and (probs > 0).all()


def test_missing_values_are_skipped_in_strict_form(spark):
    rows = [(k, 1, __import__("datetime").datetime(2020, 1, 1 + k), 7, v) for k, v in enumerate([None, 4.0, 1.0, 3.0])]
    df = spark.createDataFrame(rows, "match_id long, league int, date timestamp, team long, gf double")
    assert [r.gf_strict_2 for r in sorted(win.strict_form(df, 2, ("gf",)).collect(), key=lambda r: r.match_id)] == [None, None, 4.0, 2.5]


def test_string_ids(spark):
    names = [None, "12", " 77 ", "TM_3806", "é日", ""]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(names)), "i int, s string").orderBy("i").select(features.string_id(F.col("s"))).collect()]
    want = [0, 12, 77, *[int("".join(str(ord(c)) for c in s)) % 2**31 for s in ("TM_3806", "é日")], 0]
    assert got == want


def test_names(spark):
    known = spark.createDataFrame([(1, "Manchester City"), (2, "Manchester United"), (3, "Çaykur Rizespor"), (4, "AB"), (5, "Real Sociedad San")], "team_id long, name string")
    asked = spark.createDataFrame([(1, "manchester  city"), (2, "Caykur Rizespor"), (3, "United of Manchester"), (4, "ABC"), (5, None), (6, "Ours")], "query_id long, name string")
    fixed = spark.createDataFrame([("ours", 4)], "name string, team_id long")
    got = {r.query_id: (r.team_id, round(r.score, 3)) for r in matching.match_names(asked, known, overrides=fixed).collect()}
    assert got == {1: (1, 1.0), 2: (3, 1.0), 3: (2, 0.95), 6: (4, 1.0)}
    tiers = spark.createDataFrame([("Ab", "aB"), ("abc", "abcd"), ("abcde", "edcbaf"), ("xy", "qr")], "a string, b string").select(matching.letter_tiers(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 3) for r in tiers] == [100.0, 90.0, round(80 + 15 * 5 / 6, 3), 0.0]
    cache = spark.createDataFrame([("Real Madrid CF", "Atletico Madrid", 1, 2, 1), ("Atletico Madrid", "Real Madrid", 5, 0, 3), ("Other Town", "Real Madrid", 9, 1, 1)], "home string, away string, day int, home_goals int, away_goals int")
    (r,) = matching.cached_results(spark.createDataFrame([(1, "Real Madrid", "Atlético Madrid"), (2, "No One", "Here")], "request_id long, home string, away string"), cache).collect()
    assert (r.request_id, r.hg, r.ag, r.swapped) == (1, 3, 0, True)


def test_counts_and_weights(spark):
    df = spark.createDataFrame([(1, 2.0, 1.5)], "id int, h double, a double")
    r = decisions.count_overs(df, "h", "a", (2, 5)).first()
    pois = lambda m, k: math.exp(-m) * m**k / math.factorial(k)
    assert (r.over25, r.over55) == pytest.approx((1 - sum(pois(3.5, k) for k in range(3)), 1 - sum(pois(3.5, k) for k in range(6))))
    n = decisions.count_overs(df, "h", "a", (2,), spread=3.0).first()
    nb = lambda m, k: math.gamma(k + 3) / math.factorial(k) / math.gamma(3) * (3 / (3 + m)) ** 3 * (m / (3 + m)) ** k
    assert n.over25 == pytest.approx(1 - sum(nb(2.0, i) * nb(1.5, j) for i in range(3) for j in range(3 - i)))
    w = spark.createDataFrame([(0.5, 0.3, 0.2)], "a double, b double, c double")
    r = decisions.adjusted_weights(w, F.lit(1.0), ["a", "b", "c"]).first()
    assert (r.a, r.b, r.c) == pytest.approx((0.55, 0.35, 0.1))
    assert tuple(decisions.adjusted_weights(w, F.lit(0.2), ["a", "b", "c"]).first()) == (0.5, 0.3, 0.2)
    assert spark.range(1).select(F.size(poisson_pmf(F.lit(1.0), 20))).first()[0] == 21


def test_shrink_moves_confident_doubtful_predictions(spark):
    p = spark.createDataFrame([(1, 2, 0.9, 0.06, 0.04), (3, 4, 0.9, 0.06, 0.04)], "home_team_id long, away_team_id long, p_h double, p_d double, p_a double")
    errors = spark.createDataFrame([(1, 0.8), (2, 0.6), (3, 0.1), (4, 0.2)], "team long, error_rate double")
    got = {r.home_team_id: r for r in decisions.shrunk(p, errors).collect()}
    assert (got[1].p_h, got[1].p_d, got[1].p_a) == pytest.approx((0.84, 0.09, 0.07)) and got[3].p_h == pytest.approx(0.9) and got[1].confidence_factor == pytest.approx(0.3)


def test_bound_values_inside_nested_lambdas(spark):
    pairs = lambda s: F.transform(s["a"], lambda x: F.transform(s["b"], lambda y: x * y))
    made = spark.sql("select array(1, 2) x, array(3, 4) y union all select array(5), cast(null as array<int>)")
    got = [r[0] for r in made.select(bound(pairs, a=F.col("x"), b=F.col("y"))).collect()]
    assert len(got) == 2 and [[3, 4], [6, 8]] in got and [None] in got
