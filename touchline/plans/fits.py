"""Registered queries of fitted models, folds, name search, row order and incremental state, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import functions as fn
from touchline.operators import adjusting as adj
from touchline.operators import aggregates as agg
from touchline.operators import boosting, fold_models
from touchline.operators import decisions as dec
from touchline.operators import estimation as es
from touchline.operators import features as ft
from touchline.operators import feedback as fb
from touchline.operators import joins as jn
from touchline.operators import matching as mt
from touchline.operators import ordering
from touchline.operators import reports as rp
from touchline.operators import windows as win
from touchline.plans.matches import matches, predictions
from touchline.plans.more import _pre, r9, s9
from touchline.plans.queries import _HIT, _PICK, _sources, _SRC, query
from touchline.session import table
from touchline.sources.mapped import fetched
from touchline.streaming import state as st

FORM = ["home_gf_5", "home_ga_5", "home_pts_5", "away_gf_5", "away_ga_5", "away_pts_5", "home_elo", "away_elo", "mkt_home_prob"]


def stat_rows(spark, d):
    """Matches with form and twelve statistics of the line items, of which some are missing."""
    g = lambda c, k: F.when(F.col("match_id") % k != 0, c.cast("int"))
    made = _pre(spark, d)
    own = {}
    for side in ("home", "away"):
        goals, corners, other = F.col(f"{side}_goals"), F.col(f"{side}_corners"), F.col("match_id") % 7
        own |= {f"{side}_shots": g(3 + 2 * goals + corners + other % 3, 5), f"{side}_sot": g(goals + F.floor(corners / 2), 5), f"{side}_yellow": g(other % 4, 9), f"{side}_red": g(F.when(F.col("match_id") % 19 == 0, 1).otherwise(0), 9), f"{side}_fouls": g(8 + corners + other, 4)}
    return made.withColumns(own).withColumns({f"{s}_corners": F.when(F.col("match_id") % 6 != 0, F.col(f"{s}_corners")) for s in ("home", "away")}).withColumn("data_completeness", F.lit(0.5))


@query()
def imputed_stats(spark, d):
    """All twelve statistics after missing ones were filled from one Gram matrix, and how complete the row is."""
    rows = stat_rows(spark, d)
    return es.stats_filled(rows, es.stat_models(rows, FORM)).select("match_id", *es.STATS, *r9("data_completeness"))


_NB = """, s AS (SELECT league, greatest(avg(home_corners), 0.05e0) hm, greatest(avg(home_corners), 0.05e0) / greatest(0.01e0, var_pop(home_corners) / avg(home_corners) - 1) hr, greatest(avg(away_corners), 0.05e0) am, greatest(avg(away_corners), 0.05e0) / greatest(0.01e0, var_pop(away_corners) / avg(away_corners) - 1) ar FROM matches WHERE season < 1997 GROUP BY 1),
 h AS (SELECT league, k, exp(lgamma(k + hr) - lgamma(hr) - lgamma(k + 1) + hr * ln(hr / (hr + hm)) + k * ln(hm / (hr + hm))) p FROM s, range(21) t(k)), a AS (SELECT league, k, exp(lgamma(k + ar) - lgamma(ar) - lgamma(k + 1) + ar * ln(ar / (ar + am)) + k * ln(am / (ar + am))) p FROM s, range(21) t(k)),
 hn AS (SELECT league, k, p / sum(p) OVER (PARTITION BY league) p FROM h), an AS (SELECT league, k, p / sum(p) OVER (PARTITION BY league) p FROM a),
 o AS (SELECT hn.league, sum(CASE WHEN hn.k + an.k <= 2 THEN hn.p * an.p ELSE 0 END) b2, sum(CASE WHEN hn.k + an.k <= 3 THEN hn.p * an.p ELSE 0 END) b3, sum(CASE WHEN hn.k + an.k <= 4 THEN hn.p * an.p ELSE 0 END) b4 FROM hn JOIN an ON hn.league = an.league GROUP BY 1)"""


@query(_NB + " SELECT match_id, " + s9(over25="1 - b2", over35="1 - b3", over45="1 - b4") + " FROM matches m LEFT JOIN o ON o.league = m.league WHERE season >= 1997")
def corner_markets_fitted(spark, d):
    """Corner totals by negative binomials with each league's mean and dispersion before 1997."""
    m = matches(spark, d)
    made = es.fitted_count_overs(m.where("season < 1997"), m.where("season >= 1997"), "home_corners", "away_corners", ["league"], (2, 3, 4))
    return made.select("match_id", *r9("over25", "over35", "over45"))


def three_models(p):
    """Three models' probabilities of home, draw and away: the odds', flat rates, and a sharpened one; and what happened (0, 1, 2)."""
    flat = {"h": 0.45, "d": 0.25, "a": 0.30}
    total = sum((F.pow(f"p_{x}", F.lit(1.8)) for x in "hda"), F.lit(0.0))
    made = p.select("match_id", *[F.col(f"p_{x}").alias(f"odds_{x}") for x in "hda"], *[F.lit(v).alias(f"flat_{x}") for x, v in flat.items()], *[(F.pow(f"p_{x}", F.lit(1.8)) / total).alias(f"sharp_{x}") for x in "hda"], F.when(F.col("result") == "H", 0).when(F.col("result") == "D", 1).otherwise(2).alias("happened"))
    return made.withColumns({n: F.get(F.array(*[F.col(f"{n}_{x}") for x in "hda"]), F.col("happened")) for n in ("odds", "flat", "sharp")})


@query()
def mixture_fit(spark, d):
    """Weights of three models on the simplex, the temperature of their mean, and the log-loss before and after."""
    rows = three_models(predictions(matches(spark, d))).persist()
    names = ["odds", "flat", "sharp"]
    w = es.mixture_weights(rows, names)
    mixed = rows.select("happened", *[sum((float(k) * F.col(f"{n}_{x}") for n, k in zip(names, w, strict=True)), F.lit(0.0)).alias(f"p_{x}") for x in "hda"])
    heat = es.temperature(mixed, ["p_h", "p_d", "p_a"], "happened")
    rows.unpersist()
    total = sum((F.pow(f"p_{x}", F.lit(1 / heat)) for x in "hda"), F.lit(0.0))
    own = F.get(F.array("p_h", "p_d", "p_a"), F.col("happened"))
    loss = mixed.agg(F.count("*").alias("n"), F.avg(-F.ln(own)).alias("mixed_loss"), F.avg(-F.ln(F.pow(own, F.lit(1 / heat)) / total)).alias("heated_loss"))
    return loss.select("n", *[F.round(F.lit(float(k)), 6).alias(f"w_{n}") for n, k in zip(names, w, strict=True)], F.round(F.lit(heat), 6).alias("temperature"), *r9("mixed_loss", "heated_loss"))


def part_names(spark, d, brands=True):
    """A name of each part (with its brand, or alone), and queries: parts of names, names with a word too many, with letters changed, and words turned round."""
    k = table(spark, d, "part").select(F.col("p_partkey").alias("team_id"), (F.concat(F.lower(F.trim("p_name")), F.lit(" "), F.lower("p_brand")) if brands else F.lower(F.trim("p_name"))).alias("name"))
    n = F.col("name")
    said = F.when(F.col("team_id") % 4 == 0, F.substr(n, F.lit(2), F.length(n) - 3)).when(F.col("team_id") % 4 == 1, F.concat(F.lit("fc "), n)).when(F.col("team_id") % 4 == 2, F.translate(n, "oe", "au")).otherwise(F.concat_ws(" ", F.reverse(F.split(n, " "))))
    return k.select((F.col("team_id") + 10_000_000).alias("query_id"), said.alias("name")), k


_NAMES = """, k AS (SELECT p_partkey id, lower(trim(p_name)) || ' ' || lower(p_brand) b FROM part), q AS (SELECT id, CASE id % 4 WHEN 0 THEN substr(b, 2, length(b) - 3) WHEN 1 THEN 'fc ' || b WHEN 2 THEN translate(b, 'oe', 'au') ELSE array_to_string(list_reverse(string_split(b, ' ')), ' ') END a FROM k)"""


@query(_NAMES + " SELECT count(*) pairs, CAST(sum(q1.length) AS BIGINT) letters FROM (SELECT DISTINCT a, length(a) length FROM q WHERE length(a) > 5) q1, (SELECT DISTINCT b FROM k) k1 WHERE contains(k1.b, q1.a)")
def contained_names(spark, d):
    """How many pairs of names there are of which one is within the other, and how many letters."""
    q, k = part_names(spark, d)
    pairs = mt.contained_pairs(q.select(F.col("name").alias("a")).distinct(), k.select(F.col("name").alias("b")).distinct())
    return pairs.agg(F.count("*").alias("pairs"), F.sum(F.length("a").cast("long")).alias("letters"))


@query()
def fuzzy_club_names(spark, d):
    """For every query name the known one of the largest block ratio, 0.80 or more."""
    q, k = part_names(spark, d, brands=False)
    return mt.fuzzy_names(q, k).select("query_id", "team_id", *r9("score"))


@query()
def close_team_names(spark, d):
    """A search: the names whose number is divisible by 100, each against all names, by block ratio from 0.6 on."""
    q, k = part_names(spark, d, brands=False)
    return mt.close_names(q.where("query_id % 100 = 0"), k.where("team_id % 100 <> 0"))


_FORM = ", ".join(f"avg(CAST({c} AS DOUBLE)) OVER (PARTITION BY league, team ORDER BY date, match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) {c}_{n}" for n in (5, 10) for c in ("gf", "ga", "pts"))


@query(f", f AS (SELECT league, team, match_id, season, {_FORM} FROM lp) SELECT league, CAST(team AS BIGINT) team, match_id, " + s9(**{f"{c}_{n}": f"{c}_{n}" for n in (5, 10) for c in ("gf", "ga", "pts")}) + " FROM f WHERE season >= 1997")
def incremental_form(spark, d):
    """Form of the matches from 1997 on from the state after 1996 (30 rows a team): the same as from all matches."""
    long = win.long_view(matches(spark, d))
    made = st.advanced(st.team_state(long.where("season < 1997")), long.where("season >= 1997"))
    return made.select("league", F.col("team").cast("long").alias("team"), "match_id", *r9(*[f"{c}_{n}" for n in (5, 10) for c in ("gf", "ga", "pts")]))


@query(", f AS (SELECT league, team, min((date, match_id, is_home)) s FROM lp GROUP BY 1, 2) SELECT league, CAST(team AS BIGINT) team, CAST(999999 + row_number() OVER (ORDER BY s) AS BIGINT) id FROM f")
def first_seen_ids(spark, d):
    """Ids of teams in the order in which they first play, from a source's offset on."""
    long = win.long_view(matches(spark, d)).select("league", F.col("team").cast("long").alias("team"), "date", "match_id", "is_home")
    return ordering.first_seen_ids(long, ["league", "team"], ["date", "match_id", "is_home"], jn.OFFSETS["HF"])


@query(", n AS (SELECT match_id, row_number() OVER (ORDER BY date, match_id) - 1 r FROM matches), t AS (SELECT count(*) c FROM n), f AS (SELECT k fold, k * 150 s FROM range(100000) g(k), t WHERE k * 150 + 750 <= c) SELECT CAST(fold AS BIGINT) fold, CASE WHEN r < s + 600 THEN 'train' ELSE 'test' END part, count(*) n, min(match_id) low, CAST(sum(match_id) AS BIGINT) total FROM f JOIN n ON r >= s AND r < s + 750 GROUP BY 1, 2")
def row_fold_parts(spark, d):
    """Folds by row number in the order of time: 600 rows train, the next 150 test, and on by 150."""
    numbered = ordering.row_numbers(matches(spark, d).select("match_id", "date"), [F.col("date"), F.col("match_id")])
    return ordering.row_folds(numbered, 600, 150, 150).groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("match_id").alias("low"), F.sum("match_id").alias("total"))


@query(" SELECT CAST(k AS INT) fold, CASE WHEN season = k THEN 'test' ELSE 'train' END part, count(*) n, min(date) first, max(date) last FROM matches, range(1996, 1999) g(k) WHERE season <= k AND season >= k - 2 GROUP BY 1, 2")
def season_fold_parts(spark, d):
    made = ordering.season_folds(matches(spark, d), 1996, 1998, 2)
    return made.groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def _classes(p):
    return p.withColumn("y", F.when(F.col("result") == "H", 0).when(F.col("result") == "D", 1).otherwise(2))


@query()
def fold_model_scores(spark, d):
    """A logistic model trained before each quarter, calibrated on the last of what is before it, and scored on the quarter."""
    folds = rp.walk_forward(_classes(predictions(matches(spark, d))), "1996-01-01")
    made = fold_models.fold_report(fold_models.fitted_folds(folds, ["odds_h", "odds_d", "odds_a", "home_corners", "away_corners"], "y"))
    return made.select("fold", "model", "n", *[F.round(c, 6).alias(c) for c in ("temperature", "log_loss", "brier", "accuracy")])


@query()
def boosted_classes(spark, d):
    """Boosted probabilities of home, draw and away from 1997 on, trained on what is before, draws with half as much weight again."""
    p = _classes(predictions(matches(spark, d)))
    model = boosting.boosted(p.where("season < 1997"), ["odds_h", "odds_d", "odds_a", "home_corners", "away_corners"], "y", boosting.Boosting(rounds=5, weights=(1.0, 1.5, 1.0)))
    made = boosting.boosted_scores(p.where("season >= 1997"), model)
    return made.select("match_id", *[F.round(F.get("probabilities", F.lit(k)), 6).alias(f"p_{x}") for k, x in enumerate("hda")])


@query()
def boosted_goals(spark, d):
    """Boosted expected home goals from 1997 on, by two seeds."""
    m = matches(spark, d)
    model = boosting.boosted(m.where("season < 1997"), ["odds_h", "odds_d", "odds_a", "home_corners", "away_corners"], "home_goals", boosting.Boosting(kind="poisson", rounds=5, seeds=(7, 8)))
    return boosting.boosted_scores(m.where("season >= 1997"), model, "rate").select("match_id", F.round("rate", 6).alias("rate"))


@query(", s AS (SELECT match_id, p_h, p_d, p_a, result, unnest([0, 45]) mi FROM preds), c AS (SELECT *, match_id % 3 <> 0 AND mi + 75 + match_id % 40 >= mi AND 105 + match_id % 90 - mi BETWEEN 0 AND 180 known FROM s) SELECT match_id || '_' || mi prediction_id, CASE WHEN known THEN result END outcome, CASE WHEN known THEN round(-ln(greatest(CASE result WHEN 'H' THEN p_h WHEN 'D' THEN p_d ELSE p_a END, 1e-15)), 9) + 0.0e0 END log_loss, CASE WHEN known THEN 'settled' ELSE 'expired' END status FROM c")
def prediction_lifecycle(spark, d):
    """Predictions at kick-off and at 45 minutes, settled by results within three hours, or expired: no result comes for every third match."""
    p = predictions(matches(spark, d))
    kick = F.col("date").cast("timestamp")
    made = p.select(F.col("match_id").alias("fixture_id"), "p_h", "p_d", "p_a", kick.alias("kick"), F.explode(F.array(F.lit(0), F.lit(45))).alias("m"))
    made = made.select(F.concat_ws("_", "fixture_id", "m").alias("prediction_id"), "fixture_id", (F.col("kick") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("m"))).alias("prediction_time"), "p_h", "p_d", "p_a")
    results = p.where("match_id % 3 <> 0").select(F.col("match_id").alias("fixture_id"), (kick + F.make_dt_interval(F.lit(0), F.lit(0), (105 + F.col("match_id") % 90).cast("int"))).alias("result_time"), "home_goals", "away_goals")
    return st.lifecycle(made, results).select("prediction_id", "outcome", *r9("log_loss"), "status")


@query(", p AS (SELECT * FROM matches WHERE date >= '1996-01-01' AND home_goals IS NOT NULL AND away_goals IS NOT NULL ORDER BY date DESC, match_id DESC LIMIT 500) SELECT match_id, home_goals, away_goals FROM p")
def newest_played(spark, d):
    """A report: the newest 500 played matches from a day on."""
    return fetched(matches(spark, d), "1996-01-01", 500).select("match_id", "home_goals", "away_goals")


@query(", o AS (SELECT match_id, CASE match_id % 4 WHEN 0 THEN CAST(round(odds_h, 1) AS VARCHAR) WHEN 1 THEN '0.9' WHEN 2 THEN 'n/a' ELSE '1' END t FROM matches) SELECT match_id, CASE WHEN try_cast(t AS DOUBLE) > 1 THEN round(try_cast(t AS DOUBLE), 9) + 0.0e0 END odds FROM o")
def odds_read_safely(spark, d):
    """Odds from text: only numbers above 1 count."""
    k = F.col("match_id") % 4
    t = F.when(k == 0, F.round("odds_h", 1).cast("string")).when(k == 1, "0.9").when(k == 2, "n/a").otherwise("1")
    return matches(spark, d).select("match_id", fn.safe_odds(t).alias("odds")).select("match_id", *r9("odds"))


@query(" SELECT league, " + s9(mean="avg(CASE WHEN match_id % 5 <> 0 THEN odds_h END)") + ", count(CASE WHEN match_id % 5 <> 0 THEN 1 END) n FROM matches GROUP BY 1")
def means_without_nan(spark, d):
    """Means of a column with NaN cells, which count as missing."""
    x = fn.no_nan(F.when(F.col("match_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("odds_h")))
    return matches(spark, d).select("league", x.alias("x")).groupBy("league").agg(F.avg("x").alias("mean"), F.count("x").alias("n")).select("league", *r9("mean"), "n")


@query(" SELECT league, season, substr(sha256(array_to_string(list_sort(list(DISTINCT 'T' || home_team_id)), ',')), 1, 16) fingerprint FROM matches GROUP BY 1, 2")
def team_fingerprints(spark, d):
    """A fingerprint of each season's teams, whatever their order."""
    per = matches(spark, d).groupBy("league", "season").agg(F.collect_set(F.concat(F.lit("T"), F.col("home_team_id").cast("string"))).alias("teams"))
    return per.select("league", "season", fn.fingerprint(F.col("teams")).alias("fingerprint"))


@query(", c AS (SELECT league, season, avg(CASE WHEN match_id % (season % 5 + 2) = 0 THEN 1.0e0 ELSE 0.0e0 END) coverage FROM matches GROUP BY 1, 2) SELECT league, season, round(coverage, 9) + 0.0e0 coverage FROM c WHERE coverage < 0.3")
def low_coverage_report(spark, d):
    """Leagues and seasons of which too few rows have a statistic."""
    has = (F.col("match_id") % (F.col("season") % 5 + 2) == 0).cast("double")
    per = matches(spark, d).groupBy("league", "season").agg(F.avg(has).alias("coverage"))
    return agg.low_coverage(per, 0.3).select("league", "season", *r9("coverage"))


@query(" SELECT round(avg(home_goals) + avg(away_goals) + avg(a), 9) + 0.0e0 total, 3 AS n_columns FROM (SELECT home_goals, away_goals, CASE WHEN match_id % 4 <> 0 THEN home_corners END a FROM matches) q")
def usable_statistics(spark, d):
    """The sum of the means of the numeric columns of which less than 40 % is missing: three of four."""
    m = matches(spark, d).select("home_goals", "away_goals", F.when(F.col("match_id") % 4 != 0, F.col("home_corners")).alias("a"), F.when(F.col("match_id") % 2 == 0, F.col("away_corners")).alias("b"))
    names = agg.usable_columns(m)
    return m.agg(*[F.avg(c).alias(c) for c in names]).select(F.round(sum((F.col(c) for c in names), F.lit(0.0)), 9).alias("total"), F.lit(len(names)).alias("n_columns"))


@query(" SELECT match_id, 'tie at ' || home_goals || substr(repeat(' no side is ahead,', 200), 1, 1991) message FROM matches WHERE home_goals = away_goals AND home_goals < 10")
def logged_issues(spark, d):
    """Issues with their messages, cut to 2,000 characters as the log holds no more."""
    ties = matches(spark, d).where("home_goals = away_goals and home_goals < 10").select("match_id", "home_goals")
    return jn.issue_log(ties, F.concat(F.lit("tie at "), F.col("home_goals").cast("string"), F.repeat(F.lit(" no side is ahead,"), 200))).select("match_id", F.substring("message", 1, 1999).alias("message"))


@query(r", n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN substr(c_mktsegment, 1, 3) WHEN 2 THEN NULL ELSE ' ' || substr(c_name, 1, 2) END t FROM customer), h AS (SELECT c_custkey, t, trim(t) s FROM n) SELECT c_custkey, CAST(CASE WHEN t IS NULL THEN 0 WHEN regexp_full_match(s, '\d{1,18}') THEN CAST(s AS BIGINT) ELSE CAST(array_to_string(list_transform(string_split(s, ''), lambda x: CAST(ord(x) AS VARCHAR)), '') AS BIGINT) % 2147483648 END AS BIGINT) id FROM h")
def string_ids(spark, d):
    """Stable ids of texts: digits are the number itself, null is 0, others their code points written together modulo 2^31."""
    k = F.col("c_custkey") % 4
    t = F.when(k == 0, F.col("c_custkey").cast("string")).when(k == 1, F.substring("c_mktsegment", 1, 3)).when(k == 3, F.concat(F.lit(" "), F.substring("c_name", 1, 2)))
    return table(spark, d, "customer").select("c_custkey", ft.string_id(t).alias("id"))


_BIAS = """, r AS (SELECT home_team_id team, date, match_id, p_h, p_d, p_a, result FROM preds WHERE season < 1998 UNION ALL SELECT away_team_id, date, match_id, p_h, p_d, p_a, result FROM preds WHERE season < 1998), b AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date DESC, match_id DESC) b FROM r QUALIFY b <= 10),
 w AS (SELECT *, exp(-CASE WHEN count(*) OVER (PARTITION BY team) > 1 THEN (b - 1) / CAST(count(*) OVER (PARTITION BY team) - 1 AS DOUBLE) ELSE 1.0e0 END) w FROM b),
 g AS (SELECT team, greatest(-0.2e0, least(0.2e0, sum(w * (CAST(result='H' AS INT) - p_h)) / sum(w))) h, greatest(-0.2e0, least(0.2e0, sum(w * (CAST(result='D' AS INT) - p_d)) / sum(w))) d, greatest(-0.2e0, least(0.2e0, sum(w * (CAST(result='A' AS INT) - p_a)) / sum(w))) a FROM w GROUP BY 1),
 n AS (SELECT match_id, greatest(0.01e0, p_h + (coalesce(x.h, 0) + coalesce(y.h, 0)) / 2) h, greatest(0.01e0, p_d + (coalesce(x.d, 0) + coalesce(y.d, 0)) / 2) d, greatest(0.01e0, p_a + (coalesce(x.a, 0) + coalesce(y.a, 0)) / 2) a FROM preds p LEFT JOIN g x ON x.team = home_team_id LEFT JOIN g y ON y.team = away_team_id WHERE season >= 1998)"""


@query(_BIAS + " SELECT match_id, " + s9(p_h="h / (h + d + a)", p_d="d / (h + d + a)", p_a="a / (h + d + a)") + " FROM n")
def unbiased_predictions(spark, d):
    """Predictions from 1998 on moved by the mean errors of both teams' last ten predictions before."""
    p = predictions(matches(spark, d))
    profiles = dec.bias_profiles(fb.records(p.where("season < 1998")))
    return dec.unbiased(p.where("season >= 1998"), profiles).select("match_id", *r9("p_h", "p_d", "p_a"))


_RATED = """, r AS (SELECT *, 300 * (p_h - p_a) + 60 * (match_id % 5 - 2) g, 0.15e0 + (match_id % 7) / 10.0e0 rh, 0.10e0 + (match_id % 5) / 12.0e0 rd FROM preds), b AS (SELECT *, CASE WHEN rh BETWEEN 0.20 AND 0.70 THEN rh ELSE 0.44e0 END bh, CASE WHEN rd BETWEEN 0.15 AND 0.40 THEN rd ELSE 0.26e0 END bd, CASE WHEN abs(g) > 50 THEN 0.15e0 WHEN abs(g) > 25 THEN 0.25e0 ELSE 0.35e0 END k FROM r),
 c AS (SELECT *, p_h * (1 - k) + bh * k h1, p_d * (1 - k) + bd * k d1, p_a * (1 - k) + CASE WHEN 1 - bh - bd < 0.10 THEN 0.30e0 ELSE 1 - bh - bd END * k a1 FROM b), e AS (SELECT match_id, g, h1 / (h1 + d1 + a1) h2, d1 / (h1 + d1 + a1) d2, a1 / (h1 + d1 + a1) a2 FROM c),
 f AS (SELECT *, CASE WHEN g < -100 THEN least(0.18e0, -g / 1200) WHEN g < -50 THEN least(0.10e0, -g / 1500) WHEN g < -25 THEN least(0.05e0, -g / 2500) ELSE 0.0e0 END ga, CASE WHEN g > 100 THEN least(0.12e0, g / 1500) WHEN g > 50 THEN least(0.06e0, g / 2500) ELSE 0.0e0 END gh FROM e),
 i AS (SELECT match_id, g, greatest(0.03e0, h2 + gh - ga * CASE WHEN g < -50 THEN 0.55e0 ELSE 0.5e0 END) h3, greatest(0.03e0, d2 - gh * CASE WHEN g > 100 THEN 0.45e0 ELSE 0.5e0 END - ga * CASE WHEN g < -50 THEN 0.45e0 ELSE 0.5e0 END) d3, greatest(0.03e0, a2 + ga - gh * CASE WHEN g > 100 THEN 0.55e0 ELSE 0.5e0 END) a3 FROM f),
 j AS (SELECT match_id, g, round(h3 / (h3 + d3 + a3), 9) p_h, round(d3 / (h3 + d3 + a3), 9) p_d, round(a3 / (h3 + d3 + a3), 9) p_a FROM i)"""


@query(_RATED + " SELECT match_id, p_h + 0.0e0 p_h, p_d + 0.0e0 p_d, p_a + 0.0e0 p_a, CASE WHEN (g < -50 AND p_a > 0.25) OR (g < -100 AND p_a > 0.18) THEN 'A' WHEN g > 50 AND p_h > 0.25 THEN 'H' WHEN abs(p_h - p_a) < 0.10 AND p_h < 0.48 THEN 'D' WHEN p_h >= p_a AND p_h >= p_d THEN 'H' WHEN p_a >= p_h AND p_a >= p_d THEN 'A' ELSE 'D' END winner FROM j")
def rated_predictions(spark, d):
    """Predictions moved to their league's rates, raised by ratings, and the winner that the rule names."""
    k = F.col("match_id")
    p = predictions(matches(spark, d)).withColumns({"g": 300 * (F.col("p_h") - F.col("p_a")) + 60 * (k % 5 - 2), "rh": 0.15 + (k % 7) / 10.0, "rd": 0.10 + (k % 5) / 12.0})
    made = adj.boosted_by_rating(adj.shrunk_to_rates(p, "g", "rh", "rd"), "g").select("match_id", "g", *r9("p_h", "p_d", "p_a"))
    return made.select("match_id", "p_h", "p_d", "p_a", adj.winner(F.col("g")).alias("winner"))


_OWN = "CASE result WHEN 'H' THEN p_h WHEN 'D' THEN p_d ELSE p_a END"


@query(f", x AS (SELECT *, {_HIT} c, {_OWN} o FROM preds), y AS (SELECT 'league' kind, CAST(league AS VARCHAR) category, c, o FROM x UNION ALL SELECT 'result', result, c, o FROM x UNION ALL SELECT 'goals', CASE WHEN home_goals + away_goals >= 3 THEN '3+' WHEN home_goals + away_goals = 0 THEN '0-0' WHEN home_goals + away_goals = 1 THEN '1-0 or 0-1' WHEN greatest(home_goals, away_goals) = 2 THEN '2-0 or 0-2' ELSE '1-1' END, c, o FROM x) SELECT kind, category, count(*) n, " + s9(accuracy="avg(c)", p_happened="avg(o)", mean_error="avg(1 - o)") + " FROM y GROUP BY 1, 2 HAVING kind <> 'league' OR count(*) >= 10")
def error_by_category(spark, d):
    return adj.error_categories_of(fb.records(predictions(matches(spark, d)))).select("kind", "category", "n", *r9("accuracy", "p_happened", "mean_error"))


@query(" SELECT count(*) n, " + s9(mean="avg(greatest(p_h, p_d, p_a))", deviation="stddev_pop(greatest(p_h, p_d, p_a))") + " FROM preds")
def confidence_spread(spark, d):
    return adj.confidence_spread(fb.records(predictions(matches(spark, d)))).select("n", *r9("mean", "deviation"))


@query(", x AS (SELECT match_id, odds_h o, least((p_h - 1 / odds_h) * 0.20e0, 0.05e0) s FROM preds) SELECT match_id, " + s9(stake="CASE WHEN o > 1 AND s >= 0.005 THEN s ELSE 0 END") + " FROM x")
def small_stakes(spark, d):
    p = predictions(matches(spark, d))
    return p.select("match_id", adj.small_kelly(F.col("p_h"), F.col("odds_h")).alias("stake")).select("match_id", *r9("stake"))


@query(", b AS (SELECT league, CASE WHEN p_h >= p_d THEN 'H' WHEN p_a >= p_h THEN 'A' ELSE 'D' END pick, odds_h, odds_d, odds_a, result FROM preds), o AS (SELECT league, pick = result w, CASE pick WHEN 'H' THEN odds_h WHEN 'D' THEN odds_d ELSE odds_a END o FROM b) SELECT league, count(*) bets, CAST(sum(CAST(w AS INT)) AS BIGINT) hits, " + s9(net_roi="sum(CASE WHEN w THEN o - 1 ELSE -1 END) / count(*)", published_roi="sum(CASE WHEN w THEN o - 1 ELSE 0 END) / count(*)") + " FROM o WHERE o > 0 GROUP BY 1")
def always_best_bets(spark, d):
    return adj.always_best(predictions(matches(spark, d)), ["league"]).select("league", "bets", "hits", *r9("net_roi", "published_roi"))


@query(f", b AS (SELECT league, result, {_PICK} pick, CASE greatest(p_h * odds_h, p_d * odds_d, p_a * odds_a) WHEN p_h * odds_h THEN 'H' WHEN p_d * odds_d THEN 'D' ELSE 'A' END bet FROM preds) SELECT league, count(*) n, CAST(sum(CAST(bet = result AS INT)) AS BIGINT) best_bet_hits, CAST(sum(CAST(pick = result AS INT)) AS BIGINT) pick_hits FROM b GROUP BY 1")
def best_bet_hits(spark, d):
    return adj.best_bets(predictions(matches(spark, d)), ["league"])


@query(" SELECT 0.25e0 threshold, round(avg((p_h - CAST(result = 'H' AS INT)) * (p_h - CAST(result = 'H' AS INT))), 9) + 0.0e0 brier FROM preds")
def brier_tuning(spark, d):
    p = predictions(matches(spark, d)).withColumn("y", (F.col("result") == "H").cast("int"))
    return adj.brier_threshold(p, "y", "p_h").select("threshold", *r9("brier"))


@query(", c AS (SELECT league, season, 'corners' feature, round(avg(CASE WHEN home_corners > 0 THEN 1.0e0 ELSE 0.0e0 END), 3) coverage FROM matches GROUP BY 1, 2) SELECT * FROM c UNION ALL SELECT league, season, f, 0.0e0 FROM c, (VALUES ('weather'), ('injuries')) t(f)")
def coverage_with_missing(spark, d):
    m = matches(spark, d).withColumn("corners", F.when(F.col("home_corners") > 0, F.col("home_corners")))
    return adj.coverage_with_missing(agg.coverage(m, ["league", "season"], ["corners"]), ["league", "season"], ["weather", "injuries"])


@query(""", x AS (SELECT abs(corr(home_goals + away_goals, home_goals)) a1, abs(corr(home_goals + away_goals, away_goals)) a2, abs(corr(2 * odds_h + 1, home_goals)) b1, abs(corr(2 * odds_h + 1, odds_h)) b2, abs(corr(2 * odds_h + 1, away_goals)) b3, abs(corr(home_goals + away_goals, odds_h)) a3 FROM matches),
 y AS (SELECT 'goals' feature, greatest(a1, a2, a3) c, CASE greatest(a1, a2, a3) WHEN a1 THEN 'home_goals' WHEN a2 THEN 'away_goals' ELSE 'odds_h' END nearest FROM x UNION ALL SELECT 'twice', greatest(b1, b3, b2), CASE greatest(b1, b3, b2) WHEN b1 THEN 'home_goals' WHEN b3 THEN 'away_goals' ELSE 'odds_h' END FROM x) SELECT feature, nearest, round(c, 6) + 0.0e0 corr, CASE WHEN c < 0.7 THEN 'new' WHEN c < 0.9 THEN 'related' ELSE 'same' END kind FROM y""")
def redundant_features(spark, d):
    m = matches(spark, d).withColumns({"goals": F.col("home_goals") + F.col("away_goals"), "twice": 2 * F.col("odds_h") + 1})
    return adj.redundant_features(m, ["goals", "twice"], ["home_goals", "away_goals", "odds_h"]).select("feature", "nearest", F.round("corr", 6).alias("corr"), "kind")


@query(""", l AS (SELECT match_id id, home_team_id h, away_team_id a, date t FROM matches WHERE match_id % 2 = 0), q AS (SELECT match_id request_id, home_team_id h, away_team_id a, date t FROM matches WHERE match_id % 2 = 1)
 SELECT request_id, arg_max(id, (l.t, id)) reused_id FROM q LEFT JOIN l ON l.h = q.h AND l.a = q.a AND l.t < q.t AND date_diff('day', CAST(l.t AS DATE), CAST(q.t AS DATE)) < 14 GROUP BY 1""")
def reused_predictions(spark, d):
    """Requests that a prediction of the same sides, less than 14 days old, answers."""
    m = matches(spark, d).select(F.col("match_id").alias("id"), F.col("home_team_id").alias("home"), F.col("away_team_id").alias("away"), F.col("date").alias("at"))
    return adj.reused(m.where("id % 2 = 1").withColumnRenamed("id", "request_id"), m.where("id % 2 = 0"))


@query(_SRC + ", r AS (SELECT *, row_number() OVER (PARTITION BY CAST(date AS DATE), lower(trim(home_team)), lower(trim(away_team)) ORDER BY prio, CASE WHEN hc IS NULL THEN 0 ELSE 1 END DESC, match_id) rn FROM s) SELECT match_id, source, row_number() OVER (ORDER BY date, home_team, away_team, match_id) - 1 id FROM r WHERE rn = 1")
def canonical_matches(spark, d):
    """Merged sources without doubles, in their final order and numbered."""
    return adj.canonical(jn.dedup_by_priority(_sources(spark, d), ["hc"])).select("match_id", "source", "id")


@query()
def calibrated_classes(spark, d):
    """Class probabilities from 1998 on, calibrated by the curves of 1997 where that helps."""
    p = _classes(predictions(matches(spark, d))).select("match_id", "season", F.col("y").alias("label"), "p_h", "p_d", "p_a")
    made = adj.calibrated_classes(p.where("season = 1997"), p.where("season >= 1998"), "label", ["p_h", "p_d", "p_a"])
    return made.select("match_id", *[F.round(c, 6).alias(c) for c in ("p_h", "p_d", "p_a")], "calibrated")
