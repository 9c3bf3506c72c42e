"""Registered queries of the analytics operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import functions as fn
from touchline.operators import aggregates as agg
from touchline.operators import evaluation as ev
from touchline.operators import feedback as fb
from touchline.operators import joins as jn
from touchline.operators import fitted, live, models
from touchline.operators import settlement as st
from touchline.operators import windows as win
from touchline.plans.matches import SQL, matches, predictions
from touchline.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL on top of the shared tables if SQL can express it."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = SQL.rstrip() + "\n" + sql.strip()
        return f

    return keep


def _long(spark, d):
    return win.long_view(matches(spark, d))


def _preds(spark, d):
    return predictions(matches(spark, d))


def _recs(spark, d):
    return fb.records(_preds(spark, d))


def _near(m, asked_for):
    asked = m.where(asked_for).select(F.col("match_id").alias("request_id"), F.col("home_team_id").alias("home"), F.col("away_team_id").alias("away"), F.col("date").alias("day"))
    known = m.select(F.col("home_team_id").alias("home"), F.col("away_team_id").alias("away"), F.col("date").alias("day"), "home_goals", "away_goals", (F.col("match_id") % 3).cast("int").alias("priority"))
    return jn.results_near(asked, known).select("request_id", F.col("home_goals").alias("hg"), F.col("away_goals").alias("ag"), F.col("swapped").alias("sw"))


def sql_round(c, digits: int):
    """``c`` rounded as the SQL twin's engine does, by a whole number of steps: F.round works on the decimal text, and ties of computed values fall elsewhere."""
    return F.round(F.col(c) * 10.0**digits) / 10.0**digits


def r6(*names: str) -> list:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


T = "PARTITION BY league, team ORDER BY date, match_id"


@query("SELECT * FROM matches")
def adapter_matches(spark, d):
    return matches(spark, d)


@query("SELECT match_id, result, CASE WHEN home_goals>away_goals THEN 3 WHEN home_goals=away_goals THEN 1 ELSE 0 END pts, CASE WHEN month(date)>=7 THEN season ELSE season-1 END season_july FROM preds")
def result_labels(spark, d):
    m = matches(spark, d)
    h, a = F.col("home_goals"), F.col("away_goals")
    return m.select("match_id", fn.result_label(h, a).alias("result"), fn.points(h, a).alias("pts"), fn.season_of(F.col("date")).alias("season_july"))


@query("SELECT match_id, round(1/odds_h,6) imp_h, round(1/odds_h+1/odds_d+1/odds_a-1,6) margin, round((1/odds_h)/(1/odds_h+1/odds_d+1/odds_a),6) fair_h, round(1/(1+pow(10.0,-(odds_h*100-odds_a*100+50)/400.0)),6) elo_h FROM matches")
def odds_scalars(spark, d):
    m = matches(spark, d)
    o = [F.col(f"odds_{x}") for x in "hda"]
    return m.select("match_id", F.round(fn.implied(o[0]), 6).alias("imp_h"), F.round(fn.margin(*o), 6).alias("margin"), F.round(fn.vig_free(o[0], *o), 6).alias("fair_h"), F.round(fn.elo_expected(o[0] * 100, o[2] * 100), 6).alias("elo_h"))


@query("""SELECT match_id, CAST(home_goals>0 AND away_goals>0 AS INT) btts, CAST(home_goals+away_goals>0 AS INT) over05, CAST(home_goals+away_goals>1 AS INT) over15, CAST(home_goals+away_goals>2 AS INT) over25, CAST(home_goals+away_goals>3 AS INT) over35, CAST(home_goals+away_goals>4 AS INT) over45,
 CAST(home_goals>=away_goals AS INT) dc_1x, CAST(home_goals<=away_goals AS INT) dc_x2, CAST(home_goals<>away_goals AS INT) dc_12, CAST(home_corners+away_corners>2 AS INT) corners25, CAST(away_goals=0 AS INT) home_clean, CAST(home_goals=0 AS INT) away_clean, CAST(home_goals+away_goals BETWEEN 2 AND 3 AS INT) goals_2_3,
 CAST(home_goals-1>away_goals AS INT) handicap_win, CAST(abs(home_goals-away_goals)=1 AS INT) win_by_one, CAST((home_corners+away_corners)%2=0 AS INT) corners_even FROM matches""")
def market_targets(spark, d):
    m = matches(spark, d)
    h, a, c = F.col("home_goals"), F.col("away_goals"), F.col("home_corners") + F.col("away_corners")
    t = {"btts": (h > 0) & (a > 0), **{f"over{k}5": h + a > k for k in range(5)}, "dc_1x": h >= a, "dc_x2": h <= a, "dc_12": h != a, "corners25": c > 2, "home_clean": a == 0, "away_clean": h == 0, "goals_2_3": (h + a).between(2, 3), "handicap_win": h - 1 > a, "win_by_one": F.abs(h - a) == 1, "corners_even": c % 2 == 0}
    return m.select("match_id", *[v.cast("int").alias(k) for k, v in t.items()])


def _form_sql(n, part="league, team"):
    w = f"OVER (PARTITION BY {part} ORDER BY date, match_id ROWS BETWEEN {n or 'UNBOUNDED'} PRECEDING AND 1 PRECEDING)"
    return ", ".join(f"round(avg(CAST({c} AS DOUBLE)) {w},6) {c}_f" for c in ("gf", "ga", "pts"))


def _form(spark, d, n, by=()):
    tag = "_".join([*by, str(n or "all")])
    return win.form(_long(spark, d), n, by=by).select("match_id", "team", *[F.round(F.col(f"{c}_{tag}"), 6).alias(f"{c}_f") for c in ("gf", "ga", "pts")])


@query(f"SELECT match_id, team, {_form_sql(10)} FROM lp")
def form_last10(spark, d):
    return _form(spark, d, 10)


@query(f"SELECT match_id, team, {_form_sql(5, 'league, team, is_home')} FROM lp")
def form_venue5(spark, d):
    return _form(spark, d, 5, ("is_home",))


@query(f"SELECT match_id, team, {_form_sql(0, 'league, team, season')} FROM lp")
def form_season(spark, d):
    return _form(spark, d, 0, ("season",))


@query(""", x AS (SELECT a.match_id, a.team, b.gf, b.ga, b.pts, row_number() OVER (PARTITION BY a.match_id, a.team ORDER BY b.date DESC, b.match_id DESC) rn
 FROM lp a LEFT JOIN lp b ON a.league=b.league AND a.team=b.team AND b.date<a.date)
 SELECT match_id, team, round(avg(CAST(gf AS DOUBLE)),6) gf_f, round(avg(CAST(ga AS DOUBLE)),6) ga_f, round(avg(CAST(pts AS DOUBLE)),6) pts_f FROM x WHERE rn<=10 GROUP BY 1,2""")
def form_strict10(spark, d):
    return win.strict_form(_long(spark, d), 10).select("match_id", "team", *[F.round(F.col(f"{c}_strict_10"), 6).alias(f"{c}_f") for c in ("gf", "ga", "pts")])


@query(f"""SELECT match_id, team, CAST(sum(CASE WHEN gf>0 AND ga>0 THEN 1 ELSE 0 END) OVER w AS BIGINT) btts_5, CAST(sum(CASE WHEN gf>ga THEN 1 ELSE 0 END) OVER w AS BIGINT) wins_5, CAST(sum(CASE WHEN gf=ga THEN 1 ELSE 0 END) OVER w AS BIGINT) draws_5,
 CASE WHEN count(gf) OVER w>=3 THEN round(stddev_pop(gf) OVER w,6) END gf_std_5, round(avg(CAST(gf-ga AS DOUBLE)) OVER w,6) gd_5, round(date_diff('second', lag(date) OVER (PARTITION BY league, team ORDER BY date, match_id), date)/86400.0,6) rest_days
 FROM lp WINDOW w AS ({T} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def recent_form(spark, d):
    return win.recent(_long(spark, d)).select("match_id", "team", "btts_5", "wins_5", "draws_5", *r6("gf_std_5", "gd_5", "rest_days"))


@query(f"SELECT match_id, team, (lag(gf-ga,1) OVER ({T})) - ((lag(gf-ga,2) OVER ({T})) + (lag(gf-ga,3) OVER ({T})))/2.0 momentum FROM lp")
def momentum(spark, d):
    return win.momentum(_long(spark, d)).select("match_id", "team", "momentum")


@query(""", x AS (SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY date, match_id) rn FROM lp)
 SELECT a.match_id, a.team, round(sum(b.gf*exp(-date_diff('second', b.date, a.date)/86400.0/60))/nullif(sum(exp(-date_diff('second', b.date, a.date)/86400.0/60)),0),6) gf_decay_10
 FROM x a LEFT JOIN x b ON a.league=b.league AND a.team=b.team AND b.rn BETWEEN a.rn-10 AND a.rn-1 GROUP BY 1,2""")
def form_decay10(spark, d):
    return win.weighted_form(_long(spark, d)).select("match_id", "team", *r6("gf_decay_10"))


@query(""", x AS (SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY date, match_id) rn FROM lp)
 SELECT a.match_id, a.team, round(sum(b.pts*exp(-(a.rn-b.rn-1)/10.0))/nullif(sum(exp(-(a.rn-b.rn-1)/10.0)),0),6) pts_wform_5 FROM x a LEFT JOIN x b ON a.league=b.league AND a.team=b.team AND b.rn BETWEEN a.rn-5 AND a.rn-1 GROUP BY 1,2""")
def form_index_decay(spark, d):
    return win.index_decay_form(_long(spark, d)).select("match_id", "team", *r6("pts_wform_5"))


@query(""", x AS (SELECT *, least(home_team_id,away_team_id) lo, greatest(home_team_id,away_team_id) hi, row_number() OVER (PARTITION BY league, least(home_team_id,away_team_id), greatest(home_team_id,away_team_id) ORDER BY date, match_id) rn FROM matches)
 SELECT a.match_id, round(avg(CASE WHEN b.match_id IS NULL THEN NULL WHEN (b.home_team_id=a.home_team_id AND b.home_goals>b.away_goals) OR (b.away_team_id=a.home_team_id AND b.away_goals>b.home_goals) THEN 1.0 ELSE 0.0 END),6) h2h_home,
 round(avg(CASE WHEN b.match_id IS NULL THEN NULL WHEN b.home_goals=b.away_goals THEN 1.0 ELSE 0.0 END),6) h2h_draw, round(avg(CAST(b.home_goals+b.away_goals AS DOUBLE)),6) h2h_goals FROM x a LEFT JOIN x b ON a.league=b.league AND a.lo=b.lo AND a.hi=b.hi AND b.rn BETWEEN a.rn-5 AND a.rn-1 GROUP BY 1""")
def head_to_head(spark, d):
    return win.head_to_head(matches(spark, d)).select("match_id", *r6("h2h_home", "h2h_draw", "h2h_goals"))


_LG = ", ".join(f"{{0}}avg(CASE WHEN {c} THEN 1.0e0 ELSE 0.0e0 END) OVER w{{1}} {n}" for n, c in (("lg_home", "home_goals>away_goals"), ("lg_draw", "home_goals=away_goals"), ("lg_btts", "home_goals>0 AND away_goals>0"), ("lg_over25", "home_goals+away_goals>2")))


@query("SELECT match_id, " + _LG.format("round(coalesce(", ",0),12)") + " FROM matches WINDOW w AS (PARTITION BY league ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def league_baseline(spark, d):
    names = ("lg_home", "lg_draw", "lg_btts", "lg_over25")  # twelve digits: the engines round exact ties at the seventh differently
    return win.league_baseline(matches(spark, d)).select("match_id", *[F.round(c, 12).alias(c) for c in names])


@query("SELECT match_id, " + _LG.format("CASE WHEN count(*) OVER w>=50 THEN round(", ",6) END") + " FROM matches WINDOW w AS (PARTITION BY league ORDER BY date, match_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)")
def league_rolling200(spark, d):
    return win.league_baseline(matches(spark, d), 200, 50).select("match_id", *r6("lg_home", "lg_draw", "lg_btts", "lg_over25"))


@query(""", f AS (SELECT *, CAST(gf>ga AS INT) w, CAST(gf>=ga AS INT) u FROM lp), g AS (SELECT *, sum(1-w) OVER (PARTITION BY league, team ORDER BY date, match_id ROWS UNBOUNDED PRECEDING) gw, sum(1-u) OVER (PARTITION BY league, team ORDER BY date, match_id ROWS UNBOUNDED PRECEDING) gu FROM f),
 a AS (SELECT league, team, max(n) longest_win FROM (SELECT league, team, gw, sum(w) n FROM g GROUP BY 1,2,3) GROUP BY 1,2), b AS (SELECT league, team, max(n) longest_unbeaten FROM (SELECT league, team, gu, sum(u) n FROM g GROUP BY 1,2,3) GROUP BY 1,2)
 SELECT a.league, a.team, CAST(longest_win AS BIGINT) longest_win, CAST(longest_unbeaten AS BIGINT) longest_unbeaten FROM a JOIN b ON a.league=b.league AND a.team=b.team""")
def streaks(spark, d):
    return win.streaks(_long(spark, d))


@query("SELECT league, team, match_id, gf, ga FROM (SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY date DESC, match_id DESC) rn FROM lp) WHERE rn=1")
def latest_rows(spark, d):
    return win.latest(_long(spark, d)).select("league", "team", "match_id", "gf", "ga")


@query(""", r AS (SELECT *, row_number() OVER (PARTITION BY league, season, team ORDER BY date DESC, match_id DESC) rn FROM lp), s AS (SELECT league, season, team, count(*) pl, sum(CAST(gf>ga AS INT)) w, sum(CAST(gf=ga AS INT)) d, sum(CAST(gf<ga AS INT)) l, sum(gf) gf, sum(ga) ga, sum(gf-ga) gd, sum(pts) pts,
 sum(CAST(is_home=1 AND gf>ga AS INT)) home_w, sum(CAST(is_home=0 AND gf>ga AS INT)) away_w, sum(CAST(is_home=0 AND gf<ga AS INT)) away_l, sum(CAST(gf>0 AND ga>0 AS INT)) btts, sum(CAST(gf+ga>2 AS INT)) over25, sum(CAST(ga=0 AS INT)) clean, sum(CAST(gf=0 AS INT)) blank,
 string_agg(CASE WHEN rn<=5 THEN CASE WHEN gf>ga THEN 'W' WHEN gf=ga THEN 'D' ELSE 'L' END END, '' ORDER BY rn) form5 FROM r GROUP BY 1,2,3)
 SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY pts DESC, gd DESC, gf DESC, team) pos FROM s""")
def standings(spark, d):
    return agg.standings(_long(spark, d))


@query("SELECT league, count(*) n, round(avg(CAST(home_goals+away_goals AS DOUBLE)),6) avg_goals, " + ", ".join(f"round(avg(CASE WHEN {c} THEN 1.0e0 ELSE 0.0e0 END),6) {n}" for n, c in [("home_rate", "home_goals>away_goals"), ("draw_rate", "home_goals=away_goals"), ("away_rate", "home_goals<away_goals"), ("btts", "home_goals>0 AND away_goals>0")] + [(f"over{k}5", f"home_goals+away_goals>{k}") for k in range(5)]) + ", round(avg(CASE WHEN home_goals>away_goals THEN 1.0e0 ELSE 0.0e0 END)-avg(CASE WHEN home_goals<away_goals THEN 1.0e0 ELSE 0.0e0 END),6) home_adv, " + ", ".join(f"sum(CAST(home_goals+away_goals{'=' if k < 4 else '>='}{k} AS INT)) goals_{k}" for k in range(5)) + ", sum(home_corners+away_corners) corners FROM matches GROUP BY league")
def league_summary(spark, d):
    return agg.league_summary(matches(spark, d))


@query("SELECT count(*) n, count(DISTINCT league) leagues, round(avg(CAST(home_goals+away_goals AS DOUBLE)),6) avg_goals, round(avg(CASE WHEN home_goals>away_goals THEN 1.0e0 ELSE 0.0e0 END),6) home_rate, min(date) first_day, max(date) last_day, (SELECT count(DISTINCT team) FROM lp) teams FROM matches")
def dashboard_kpis(spark, d):
    m = matches(spark, d)
    return agg.kpis(m, win.long_view(m))


@query(""", x AS (SELECT league, season, CASE WHEN home_corners>0 THEN home_corners END a, CASE WHEN away_goals>0 THEN away_goals END b FROM matches)
 SELECT league, season, 'a' feature, round(avg(CASE WHEN a IS NULL THEN 0.0e0 ELSE 1.0e0 END),3) coverage FROM x GROUP BY 1,2 UNION ALL SELECT league, season, 'b', round(avg(CASE WHEN b IS NULL THEN 0.0e0 ELSE 1.0e0 END),3) FROM x GROUP BY 1,2""")
def coverage_matrix(spark, d):
    m = matches(spark, d).select("league", "season", F.when(F.col("home_corners") > 0, F.col("home_corners")).alias("a"), F.when(F.col("away_goals") > 0, F.col("away_goals")).alias("b"))
    return agg.coverage(m, ["league", "season"], ["a", "b"])


@query(""", o AS (SELECT league, team, opp, count(*) c FROM lp GROUP BY 1,2,3), t AS (SELECT league, team, opp top_opp FROM (SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY c DESC, opp DESC) rn FROM o) WHERE rn=1)
 SELECT lp.league, lp.team, count(*) pl, sum(pts) pts, round(avg(CAST(CASE WHEN is_home=1 THEN gf END AS DOUBLE)),6) home_gf, round(avg(CAST(CASE WHEN is_home=0 THEN gf END AS DOUBLE)),6) away_gf, max(gf-ga) biggest_win, min(gf-ga) biggest_loss, sum(CAST(gf>=4 AS INT)) four_plus, max(top_opp) top_opp FROM lp JOIN t ON lp.league=t.league AND lp.team=t.team GROUP BY 1,2""")
def team_profile(spark, d):
    return agg.team_profile(_long(spark, d))


@query("SELECT league, team, month(date) AS month, count(*) pl, sum(pts) pts FROM lp GROUP BY 1,2,3")
def team_monthly(spark, d):
    return agg.monthly(_long(spark, d))


@query(", p AS (SELECT team, count(*) n FROM lp GROUP BY 1) SELECT min(n) least, median(n) median, max(n) most, sum(CAST(n<20 AS INT)) below_20, sum(CAST(n<50 AS INT)) below_50 FROM p")
def matches_per_team(spark, d):
    return agg.matches_per_team(_long(spark, d))


@query(", c AS (SELECT home_team_id, count(*) n FROM matches GROUP BY 1), t AS (SELECT *, sum(n) OVER () total FROM c ORDER BY n DESC, home_team_id LIMIT 15) SELECT home_team_id, n, round(n/CAST(total AS DOUBLE),6) share, round(sum(n) OVER (ORDER BY n DESC, home_team_id)/CAST(total AS DOUBLE),6) running FROM t")
def value_shares(spark, d):
    return agg.shares(matches(spark, d), "home_team_id")


@query("SELECT " + ", ".join([f"round(avg(1/odds_{x}),6) implied_{x}" for x in "hda"] + [f"round(avg(CASE WHEN result='{x.upper()}' THEN 1.0e0 ELSE 0.0e0 END),6) actual_{x}" for x in "hda"] + [f"round({f}(1/odds_h+1/odds_d+1/odds_a-1),6) margin_{n}" for f, n in (("avg", "mean"), ("min", "min"), ("max", "max"))]) + " FROM preds")
def implied_against_actual(spark, d):
    return agg.implied_against_actual(_preds(spark, d))


@query("SELECT 'odds_h' feature, round(corr(odds_h, home_goals),6) corr FROM matches UNION ALL SELECT 'home_corners', round(corr(home_corners, home_goals),6) FROM matches")
def correlation_screen(spark, d):
    return agg.correlations(matches(spark, d), "home_goals", ["odds_h", "home_corners"])


@query(", b AS (SELECT league, CAST(date < lag(date) OVER (PARTITION BY league ORDER BY match_id) AS INT) b FROM matches) SELECT league, CAST(coalesce(sum(b),0) AS BIGINT) steps_back FROM b GROUP BY 1")
def date_order_check(spark, d):
    return agg.in_order(matches(spark, d))


@query(", x AS (SELECT match_id, league, CASE WHEN home_corners>0 THEN CAST(home_corners AS DOUBLE) END hc FROM matches) SELECT match_id, round(coalesce(hc, avg(hc) OVER (PARTITION BY league), avg(hc) OVER ()),6) hc FROM x")
def group_imputation(spark, d):
    m = matches(spark, d).select("match_id", "league", F.when(F.col("home_corners") > 0, F.col("home_corners").cast("double")).alias("hc"))
    return agg.fill_means(m, ["hc"]).select("match_id", *r6("hc"))


def _sources(spark, d):
    m = matches(spark, d)
    names = m.select("match_id", "date", F.concat(F.lit("Team "), F.col("home_team_id").cast("string")).alias("home_team"), F.concat(F.lit("Team "), F.col("away_team_id").cast("string")).alias("away_team"), "home_goals", "away_goals", F.when(F.col("home_corners") > 0, F.col("home_corners")).alias("hc"))
    second = F.struct((F.col("match_id") + 10_000_000).alias("match_id"), F.upper("home_team").alias("home_team"), F.concat(F.lit(" "), "away_team").alias("away_team"), F.lit("FD").alias("source"))
    both = F.filter(F.array(F.struct("match_id", "home_team", "away_team", F.lit("HF").alias("source")), F.when(F.col("match_id") % 3 == 0, second)), lambda x: x.isNotNull())
    return jn.unify([names.select("date", "home_goals", "away_goals", "hc", F.inline(both))])  # one pass over the matches


_SRC = """, s AS (SELECT match_id, date, 'Team ' || home_team_id home_team, 'Team ' || away_team_id away_team, home_goals, CASE WHEN home_corners>0 THEN home_corners END hc, 5 prio, 'HF' source FROM matches
 UNION ALL SELECT match_id+10000000, date, upper('Team ' || home_team_id), ' Team ' || away_team_id, home_goals, CASE WHEN home_corners>0 THEN home_corners END, 0, 'FD' FROM matches WHERE match_id%3=0)"""


@query(_SRC + ", r AS (SELECT *, row_number() OVER (PARTITION BY CAST(date AS DATE), lower(trim(home_team)), lower(trim(away_team)) ORDER BY prio, CASE WHEN hc IS NULL THEN 0 ELSE 1 END DESC, match_id) rn FROM s) SELECT match_id, source FROM r WHERE rn=1")
def dedup_priority(spark, d):
    return jn.dedup_by_priority(_sources(spark, d), ["hc"]).select("match_id", "source")


@query(", n AS (SELECT DISTINCT league, 'T' || home_team_id nm FROM matches), r AS (SELECT *, row_number() OVER (ORDER BY league, nm) rn FROM n) SELECT m.match_id, CAST(999999 + rn AS BIGINT) team_id FROM matches m JOIN r ON r.league=m.league AND r.nm='T' || m.home_team_id")
def surrogate_ids(spark, d):
    m = matches(spark, d).select("match_id", "league", F.concat(F.lit("T"), F.col("home_team_id").cast("string")).alias("nm"))
    return jn.surrogate_ids(m, "league", "nm", "HF").select("match_id", F.col("team_id").cast("long").alias("team_id"))


@query(""", q AS (SELECT match_id request_id, home_team_id home, away_team_id away, date FROM matches WHERE season=1995), r AS (SELECT home_team_id home, away_team_id away, date rd, home_goals hg, away_goals ag, CAST(match_id%3 AS INT) p, false sw FROM matches UNION ALL SELECT away_team_id, home_team_id, date, away_goals, home_goals, CAST(match_id%3 AS INT), true FROM matches),
 f AS (SELECT q.request_id, r.hg, r.ag, r.sw, row_number() OVER (PARTITION BY request_id ORDER BY p, abs(date_diff('day', CAST(q.date AS DATE), CAST(rd AS DATE))), sw, rd, hg, ag) rn FROM q JOIN r ON q.home=r.home AND q.away=r.away AND abs(date_diff('day', CAST(q.date AS DATE), CAST(rd AS DATE)))<=7) SELECT request_id, hg, ag, sw FROM f WHERE rn=1""")
def results_near(spark, d):
    return _near(matches(spark, d), "season = 1995")


@query(""", q AS (SELECT match_id request_id, home_team_id home, away_team_id away, date FROM matches), r AS (SELECT home_team_id home, away_team_id away, date rd, home_goals hg, away_goals ag, CAST(match_id%3 AS INT) p, false sw FROM matches UNION ALL SELECT away_team_id, home_team_id, date, away_goals, home_goals, CAST(match_id%3 AS INT), true FROM matches),
 f AS (SELECT q.request_id, r.hg, r.ag, r.sw, row_number() OVER (PARTITION BY request_id ORDER BY p, abs(date_diff('day', CAST(q.date AS DATE), CAST(rd AS DATE))), sw, rd, hg, ag) rn FROM q JOIN r ON q.home=r.home AND q.away=r.away AND abs(date_diff('day', CAST(q.date AS DATE), CAST(rd AS DATE)))<=7) SELECT request_id, hg, ag, sw FROM f WHERE rn=1""")
def results_near_all(spark, d):
    """Every match is a request; results_near asks for one season, as its SQL does."""
    return _near(matches(spark, d), "true")


@query(", u AS (SELECT match_id, max(home_corners+1) nc FROM matches WHERE match_id%2=0 GROUP BY 1) SELECT m.match_id, CASE WHEN home_corners<>0 THEN home_corners WHEN nc IS NOT NULL AND nc<>0 THEN nc ELSE home_corners END home_corners FROM matches m LEFT JOIN u ON u.match_id=m.match_id")
def enrich_cells(spark, d):
    m = matches(spark, d).select("match_id", "home_corners")
    return jn.enrich(m, m.where("match_id % 2 = 0").withColumn("home_corners", F.col("home_corners") + 1), ["match_id"], ["home_corners"])


@query(""", v AS (SELECT match_id, home_team_id, CASE WHEN match_id%5=0 THEN home_team_id ELSE away_team_id END away_team_id, home_goals - CAST(match_id%7=0 AS INT)*10 home_goals, away_goals, home_corners ht FROM matches)
 SELECT match_id, 'same_team' issue FROM v WHERE home_team_id=away_team_id UNION ALL SELECT match_id, 'negative_goals' FROM v WHERE home_goals<0 OR away_goals<0 UNION ALL SELECT match_id, 'impossible_score' FROM v WHERE ht>home_goals""")
def validation_issues(spark, d):
    m = matches(spark, d).select("match_id", "date", "home_team_id", F.when(F.col("match_id") % 5 == 0, F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("away_team_id"), (F.col("home_goals") - (F.col("match_id") % 7 == 0).cast("int") * 10).alias("home_goals"), "away_goals", F.col("home_corners").alias("ht_home_goals"), F.lit(0).alias("ht_away_goals"), F.lit("x").alias("home_team"))
    return jn.validation_issues(m)


@query(", o AS (SELECT c_custkey k, c_name name FROM customer), n AS (SELECT c_custkey k, CASE WHEN c_custkey%2=0 THEN '' ELSE c_name || '!' END name FROM customer WHERE c_custkey%3=0 UNION ALL SELECT c_custkey+1000000, c_name FROM customer WHERE c_custkey%5=0) SELECT coalesce(o.k,n.k) k, coalesce(nullif(n.name,''),o.name) name FROM o FULL JOIN n ON o.k=n.k")
def upsert_names(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    new = c.where("k % 3 = 0").withColumn("name", F.when(F.col("k") % 2 == 0, "").otherwise(F.concat("name", F.lit("!")))).union(c.where("k % 5 = 0").withColumn("k", F.col("k") + 1_000_000)).withColumn("at", F.lit(1))
    return jn.upsert(c, new, ["k"], "at")


@query(", n AS (SELECT lower(trim(p_name)) k, max(p_size) pop FROM part GROUP BY 1), s AS (SELECT k AS key, pop popularity, CASE WHEN k LIKE 'a%' THEN 100 WHEN k LIKE '%a%' THEN 60 ELSE 0 END score FROM n) SELECT key, score, popularity FROM s WHERE score>0 ORDER BY score DESC, popularity DESC, key LIMIT 30")
def name_search(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("popularity"))
    return jn.search_names(p, "a")


_PICK = "CASE WHEN p_h>=p_d AND p_h>=p_a THEN 'H' WHEN p_d>=p_a THEN 'D' ELSE 'A' END"
_PR = "CASE result WHEN 'H' THEN p_h WHEN 'D' THEN p_d ELSE p_a END"
_HIT = f"CASE WHEN {_PICK}=result THEN 1.0e0 ELSE 0.0e0 END"
_BR = "pow(p_h-CASE WHEN result='H' THEN 1 ELSE 0 END,2)+pow(p_d-CASE WHEN result='D' THEN 1 ELSE 0 END,2)+pow(p_a-CASE WHEN result='A' THEN 1 ELSE 0 END,2)"


@query(f"SELECT league, count(*) n, round(avg(-ln({_PR})),6) log_loss, round(avg({_BR}),6) brier, round(avg({_HIT}),6) accuracy FROM preds GROUP BY 1")
def league_scores(spark, d):
    return ev.scores(_preds(spark, d), ["league"])


@query(f"SELECT {_PICK} predicted, result actual, count(*) n FROM preds GROUP BY 1,2")
def confusion_matrix(spark, d):
    return ev.confusion(_preds(spark, d))


@query(f", x AS (SELECT {_PICK} p, result r FROM preds), k AS (SELECT DISTINCT r k FROM x UNION SELECT DISTINCT p FROM x), s AS (SELECT k, (SELECT count(*) FROM x WHERE p=k) pr, (SELECT count(*) FROM x WHERE r=k) ac, (SELECT count(*) FROM x WHERE r=k AND p=k) h FROM k) SELECT k AS class, round(h/nullif(CAST(pr AS DOUBLE),0),6) AS precision, round(h/nullif(CAST(ac AS DOUBLE),0),6) recall, round(2.0e0*h/nullif(pr+ac,0),6) f1 FROM s")
def class_report(spark, d):
    return ev.class_report(_preds(spark, d))


@query(", x AS (SELECT CAST(result='H' AS INT) y, round(p_h,4) s FROM preds), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1)/2.0 rk FROM x) SELECT round((sum(CASE WHEN y=1 THEN rk END) - sum(y)*(sum(y)+1)/2.0)/(CAST(sum(y) AS DOUBLE)*sum(1-y)),6) auc FROM r")
def auc_home(spark, d):
    p = _preds(spark, d).select((F.col("result") == "H").alias("y"), F.round("p_h", 4).alias("s"))
    return ev.auc(p.withColumn("y", F.col("y").cast("int")), "y", "s").select(*r6("auc"))


@query(", x AS (SELECT CAST(result='H' AS INT) y, p_h p, least(CAST(floor(p_h*10) AS INT),9) b FROM preds), g AS (SELECT b, count(*) n, avg(p) mp, avg(y) my FROM x GROUP BY b) SELECT round(sum(n*abs(mp-my))/sum(n),6) ece FROM g")
def calibration_error(spark, d):
    return ev.calibration_error(_preds(spark, d).withColumn("y", (F.col("result") == "H").cast("int")), "y", "p_h")


@query(", x AS (SELECT CAST(home_goals AS DOUBLE) y, 3*p_h p FROM preds) SELECT round(avg(abs(y-p)),6) mae, round(sqrt(avg((y-p)*(y-p))),6) rmse, round(avg(2*(CASE WHEN y>0 THEN y*ln(y/p) ELSE 0 END-(y-p))),6) deviance FROM x")
def goal_errors(spark, d):
    return ev.goal_errors(_preds(spark, d).withColumn("l", 3 * F.col("p_h")), "home_goals", "l")


@query(f", t AS (SELECT round(0.35+i*0.05,6) AS threshold, i FROM range(8) r(i)), x AS (SELECT floor((greatest(p_h,p_d,p_a)-0.35)/0.05+1e-9) k, CAST({_PICK}=result AS INT) h FROM preds) SELECT CAST(threshold AS DOUBLE) threshold, count(*) picks, sum(h) hits FROM t JOIN x ON k>=i GROUP BY 1")
def threshold_sweep(spark, d):
    return ev.threshold_sweep(_preds(spark, d))


@query(", x AS (SELECT *, CAST(floor(((year(date)-1995)*12+month(date)-1)/3.0) AS INT) f FROM preds) SELECT f fold, count(*) n FROM x WHERE f BETWEEN 0 AND 3 GROUP BY 1")
def walk_forward_folds(spark, d):
    return ev.folds(_preds(spark, d), "1995-01-01").where("fold is not null").groupBy("fold").agg(F.count("*").alias("n"))


_EDGE = "greatest(p_h*odds_h-1,p_d*odds_d-1,p_a*odds_a-1)"
_SEL = f"CASE WHEN {_EDGE}<0.03 THEN -1 WHEN p_h*odds_h-1={_EDGE} THEN 0 WHEN p_d*odds_d-1={_EDGE} THEN 1 ELSE 2 END"


@query(f"SELECT match_id, round({_EDGE},6) edge, {_SEL} selection, round(least(greatest((p_h*odds_h-1)/(odds_h-1)*0.5,0),0.25),6) kelly FROM preds")
def value_bets(spark, d):
    made = ev.value_bets(_preds(spark, d))
    return made.select("match_id", *r6("edge"), "selection", F.round(ev.kelly(F.col("p_h"), F.col("odds_h"), 0.5), 6).alias("kelly"))


_BETS = f", b AS (SELECT *, {_SEL} s FROM preds), w AS (SELECT *, CASE s WHEN 0 THEN odds_h WHEN 1 THEN odds_d ELSE odds_a END o, CAST(CASE s WHEN 0 THEN 'H' WHEN 1 THEN 'D' ELSE 'A' END=result AS INT) won FROM b WHERE s>=0)"


@query(_BETS + " SELECT league, count(*) bets, sum(won) hits, round(sum(CASE WHEN won=1 THEN o-1 ELSE -1.0 END)/count(*),6) roi FROM w GROUP BY 1")
def betting_report(spark, d):
    return ev.betting_report(_preds(spark, d), by=["league"])


@query(f", t AS (SELECT round(i*0.02,6) AS threshold, i FROM range(7) r(i)), x AS (SELECT floor({_EDGE}/0.02) k, CASE WHEN p_h*odds_h-1={_EDGE} THEN odds_h WHEN p_d*odds_d-1={_EDGE} THEN odds_d ELSE odds_a END o, CASE WHEN p_h*odds_h-1={_EDGE} THEN 'H' WHEN p_d*odds_d-1={_EDGE} THEN 'D' ELSE 'A' END s, result FROM preds) SELECT CAST(threshold AS DOUBLE) threshold, count(*) bets, round(sum(CASE WHEN s=result THEN o-1 ELSE -1.0 END)/count(*),6) roi FROM t JOIN x ON k>=i GROUP BY 1")
def edge_tuning(spark, d):
    return ev.tune_edge(_preds(spark, d))


@query(", c AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) closing, arg_min(value, (ts, event_id)) AS opening, count(*) snapshots FROM events GROUP BY 1,2) SELECT user_id, event_type, closing, opening, snapshots, round(opening/nullif(closing,0)-1,6) clv FROM c")
def closing_line(spark, d):
    made = ev.closing(table(spark, d, "events"), ["user_id", "event_type"], "value", "ts", "event_id")
    return ev.clv(made, "opening", "closing").select("user_id", "event_type", "closing", "opening", "snapshots", *r6("clv"))


@query(f", p AS (SELECT season AS period, count(*) n, round(avg(-ln({_PR})),6) log_loss, round(avg({_BR}),6) brier, round(avg({_HIT}),6) accuracy FROM preds GROUP BY 1) SELECT period, n, log_loss, brier, accuracy, round(brier-lag(brier) OVER (ORDER BY period),6) d_brier, coalesce(brier-lag(brier) OVER (ORDER BY period)>=0.02 OR log_loss-lag(log_loss) OVER (ORDER BY period)>=0.03 OR accuracy-lag(accuracy) OVER (ORDER BY period)<=-0.03, false) alarm FROM p")
def drift_alarms(spark, d):
    return ev.drift(_preds(spark, d), F.col("season")).select("period", "n", "log_loss", "brier", "accuracy", *r6("d_brier"), "alarm")


@query()
def elo_ratings(spark, d):
    made = models.elo_ratings(matches(spark, d))
    return made.select("match_id", "league", "home_team_id", "away_team_id", *r6("home_elo", "away_elo", "home_att", "home_def", "away_att", "away_def"))


@query()
def elo_1x2(spark, d):
    return models.elo_1x2(models.elo_ratings(matches(spark, d))).select("match_id", *r6("p_h", "p_d", "p_a"))


@query()
def opponent_strength(spark, d):
    return models.opponent_strength(models.elo_ratings(matches(spark, d))).select("match_id", "team", *r6("opp_strength"))


_FACT = "CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 6 WHEN 4 THEN 24 WHEN 5 THEN 120 WHEN 6 THEN 720 WHEN 7 THEN 5040 WHEN 8 THEN 40320 WHEN 9 THEN 362880 ELSE 3628800 END"


@query(f", r AS (SELECT match_id, 0.4+2*p_h lh, 0.3+2*p_a la FROM preds), g AS (SELECT CAST(i AS INT) k FROM range(11) t(i)), f AS (SELECT k, {_FACT} fa FROM g), c AS (SELECT match_id, h.k h, a.k a, exp(-lh)*pow(lh,h.k)/h.fa*exp(-la)*pow(la,a.k)/a.fa*CASE WHEN h.k=0 AND a.k=0 THEN 1-lh*la*(-0.1) WHEN h.k=0 AND a.k=1 THEN 1+lh*(-0.1) WHEN h.k=1 AND a.k=0 THEN 1+la*(-0.1) WHEN h.k=1 AND a.k=1 THEN 1+0.1 ELSE 1 END p FROM r, f h, f a) SELECT match_id, round(sum(CASE WHEN h>a THEN p ELSE 0 END)/sum(p),6) p_h, round(sum(CASE WHEN h=a THEN p ELSE 0 END)/sum(p),6) p_d, round(sum(CASE WHEN h<a THEN p ELSE 0 END)/sum(p),6) p_a, round(sum(CASE WHEN h>0 AND a>0 THEN p ELSE 0 END)/sum(p),6) btts, round(sum(CASE WHEN h+a>2 THEN p ELSE 0 END)/sum(p),6) over25 FROM c GROUP BY 1")
def score_markets(spark, d):
    r = _preds(spark, d).select("match_id", (0.4 + 2 * F.col("p_h")).alias("lh"), (0.3 + 2 * F.col("p_a")).alias("la"))
    return models.markets(r, "match_id", "lh", "la", 10, -0.1).select("match_id", *r6("p_h", "p_d", "p_a", "btts", "over25"))


@query(", r AS (SELECT match_id, 0.7+2*p_h+2*p_a t FROM preds) SELECT match_id, round(1-exp(-t)*(1+t),6) over15, round(1-exp(-t)*(1+t+t*t/2),6) over25, round(1-exp(-t)*(1+t+t*t/2+t*t*t/6),6) over35 FROM r")
def poisson_overs(spark, d):
    t = 0.7 + 2 * F.col("p_h") + 2 * F.col("p_a")
    return _preds(spark, d).select("match_id", *[F.round(c, 6).alias(n) for n, c in models.total_overs(t).items()])


@query(", b AS (SELECT *, (1/odds_h)/(1/odds_h+1/odds_d+1/odds_a) bh, (1/odds_d)/(1/odds_h+1/odds_d+1/odds_a) bd, (1/odds_a)/(1/odds_h+1/odds_d+1/odds_a) ba FROM preds), e AS (SELECT match_id, pow(bh,0.65)*pow(p_h,0.35) h, pow(bd,0.65)*pow(p_d,0.35) d, pow(ba,0.65)*pow(p_a,0.35) a FROM b) SELECT match_id, round(h/(h+d+a),6) b_h, round(d/(h+d+a),6) b_d, round(a/(h+d+a),6) b_a FROM e")
def market_blend(spark, d):
    return models.market_blend(_preds(spark, d)).select("match_id", *r6("b_h", "b_d", "b_a"))


_RECS = f", recs AS (SELECT *, {_PICK} predicted, greatest(p_h,p_d,p_a) confidence, CAST({_PICK}=result AS INT) correct, greatest(p_h,p_d,p_a)-{_PR} error_margin, -ln({_PR}) loss FROM preds)"


@query(_RECS + " SELECT match_id, predicted, round(confidence,6) confidence, correct, round(error_margin,6) error_margin, round(loss,6) loss FROM recs")
def prediction_records(spark, d):
    return _recs(spark, d).select("match_id", "predicted", *r6("confidence"), "correct", *r6("error_margin", "loss"))


@query(_RECS + " SELECT CAST(least(home_goals+away_goals,4) AS INT) category, count(*) n, round(1-avg(correct),6) error_rate FROM recs GROUP BY 1 HAVING count(*)>=10")
def error_categories(spark, d):
    return fb.by_category(_recs(spark, d), F.least(F.col("home_goals") + F.col("away_goals"), F.lit(4)))


@query(_RECS + " SELECT least(CAST(floor(confidence*10) AS INT),9) bin, count(*) n, round(avg(confidence),6) mean FROM recs GROUP BY 1")
def confidence_histogram(spark, d):
    return fb.confidence_histogram(_recs(spark, d))


@query(_RECS + ", r AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY date DESC, match_id DESC) rn FROM recs), t AS (SELECT league, 1-correct wrong, home_team_id team FROM r WHERE rn<=500 UNION ALL SELECT league, 1-correct, away_team_id FROM r WHERE rn<=500), g AS (SELECT league, team, count(*) n, sum(wrong) errors FROM t GROUP BY 1,2) SELECT league, team, n, errors, round(CASE WHEN n>=3 THEN errors/CAST(n AS DOUBLE) ELSE 0 END,6) rate, CASE WHEN n>=3 THEN errors/CAST(n AS DOUBLE)>0.4 ELSE false END warning FROM g")
def error_memory(spark, d):
    return fb.error_memory(_recs(spark, d))


@query()
def error_patterns(spark, d):
    return fb.patterns(_recs(spark, d))


@query(_RECS + ", g AS (SELECT CASE WHEN abs(odds_h-odds_a)*50<50 THEN 'close' WHEN abs(odds_h-odds_a)*50<100 THEN 'slight' WHEN abs(odds_h-odds_a)*50<200 THEN 'clear' ELSE 'strong' END AS type, predicted, count(*) n, avg(correct) h, avg(confidence) c FROM recs GROUP BY 1,2), z AS (SELECT *, (h-c)/nullif(sqrt(c*(1-c)/n),0) zz FROM g) SELECT type, predicted, n, round(zz,6) z, round(CASE WHEN abs(zz)>1.96 AND n>=30 THEN greatest(-0.04,least(0.04,0.3*(h-c))) ELSE 0 END,6) AS shift FROM z")
def z_adjustment(spark, d):
    return fb.z_adjustment(_recs(spark, d), fn.match_type((F.col("odds_h") - F.col("odds_a")) * 50))


@query(""", s(label, m) AS (VALUES ('T-48H',2880),('T-24H',1440),('T-12H',720),('T-6H',360),('T-3H',180),('T-1H',60),('T-30M',30),('T-10M',10),('KO',0)) SELECT match_id, label, match_id || '_' || label snapshot_id, date - m * INTERVAL 1 MINUTE AS "at" FROM matches, s""")
def snapshot_schedule(spark, d):
    return live.snapshot_schedule(matches(spark, d))


@query(""", e AS (SELECT user_id, ts, event_id, (abs(value)%10+1)/(abs(value)%10+1+2+3) p_h, 2/(abs(value)%10+1+2+3) p_d, 3/(abs(value)%10+1+2+3) p_a FROM events), c AS (SELECT user_id, abs(p_h-lag(p_h) OVER w)+abs(p_d-lag(p_d) OVER w)+abs(p_a-lag(p_a) OVER w) c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(avg(c),6) stability, count(*) n FROM c GROUP BY 1""")
def prediction_stability(spark, d):
    v = F.abs("value") % 10 + 1
    e = table(spark, d, "events").select("user_id", "ts", "event_id", (v / (v + 5)).alias("p_h"), (2 / (v + 5)).alias("p_d"), (3 / (v + 5)).alias("p_a"))
    return live.stability(e, "user_id", ["ts", "event_id"])


@query(", e AS (SELECT event_id, event_id%120 m, abs(value)%3 x FROM events) SELECT event_id, round(x+1.5*greatest(0,(90-m)/90.0),6) lh, round(1.1*least(m/90.0,1)+1.1*greatest(0,(90-m)/90.0),6) la FROM e")
def live_rates(spark, d):
    e = table(spark, d, "events")
    lh, la = live.live_rates(F.col("event_id") % 120, F.lit(1.5), F.lit(1.1), F.abs("value") % 3, F.lit(None).cast("double"))
    return e.select("event_id", F.round(lh, 6).alias("lh"), F.round(la, 6).alias("la"))


@query("SELECT date_trunc('hour', ts) AS \"start\", event_type, count(*) n, round(sum(value),6) total FROM events GROUP BY 1,2")
def event_windows(spark, d):
    from touchline.streaming.events import windowed_prices

    made = windowed_prices(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return made.withColumn("start", F.col("start").cast("timestamp_ntz"))


def _lines():
    h, a = F.col("home_goals"), F.col("away_goals")
    known = F.when(F.col("home_corners") > 0, F.col("home_corners") + F.col("away_corners"))
    return {"btts": (F.col("p_d") + 0.3, (h > 0) & (a > 0)), "over15": (F.col("p_h") + 0.3, h + a >= 2), "over25": (F.col("p_h") + 0.1, h + a >= 3), "over35": (F.col("p_h"), h + a >= 4), "corners45": (F.col("p_a") + 0.2, known >= 5), "home_over15": (F.col("p_h") + 0.05, h >= 2)}


_LEGS = f""", base AS (SELECT *, CASE result WHEN 'H' THEN '1' WHEN 'D' THEN 'X' ELSE '2' END sign, CASE {_PICK} WHEN 'H' THEN '1' WHEN 'D' THEN 'X' ELSE '2' END pick1, greatest(p_h,p_d,p_a) top, greatest(p_h+p_a,p_h+p_d,p_d+p_a) top2, CASE WHEN home_corners>0 THEN home_corners+away_corners END kc FROM preds),
 dc AS (SELECT *, CASE WHEN p_h+p_a=top2 THEN '12' WHEN p_h+p_d=top2 THEN '1X' ELSE 'X2' END pick2 FROM base),
 yn AS (SELECT match_id, 'btts' market, p_d+0.3 p, home_goals>0 AND away_goals>0 t FROM dc UNION ALL SELECT match_id, 'over15', p_h+0.3, home_goals+away_goals>=2 FROM dc UNION ALL SELECT match_id, 'over25', p_h+0.1, home_goals+away_goals>=3 FROM dc
  UNION ALL SELECT match_id, 'over35', p_h, home_goals+away_goals>=4 FROM dc UNION ALL SELECT match_id, 'corners45', p_a+0.2, kc>=5 FROM dc WHERE kc IS NOT NULL UNION ALL SELECT match_id, 'home_over15', p_h+0.05, home_goals>=2 FROM dc),
 legs AS (SELECT match_id, '1x2' market, pick1 pick, top p, pick1=sign won FROM dc UNION ALL SELECT match_id, 'double_chance', pick2, top2, contains(pick2, sign) FROM dc UNION ALL SELECT match_id, market, CASE WHEN p>=0.5 THEN 'yes' ELSE 'no' END, greatest(p,1-p), (p>=0.5)=t FROM yn)"""


@query(_LEGS + " SELECT match_id, market, pick, round(p,6) p, won FROM legs")
def coupon_legs(spark, d):
    return st.settled_legs(_preds(spark, d), _lines()).select("match_id", "market", "pick", *r6("p"), "won")


@query(_LEGS + " SELECT match_id, CAST(sum(CAST(won AS INT)) AS BIGINT) won, count(*) markets, sum(CAST(won AS INT)) || '/' || count(*) score FROM legs GROUP BY 1")
def coupon_scores(spark, d):
    return st.coupon_scores(st.settled_legs(_preds(spark, d), _lines()))


@query(", x AS (SELECT *, row_number() OVER (PARTITION BY home_team_id ORDER BY date DESC, match_id DESC) rn FROM matches) SELECT home_team_id, round(avg(CAST(home_goals AS DOUBLE)),6) gf, round(avg(CAST(away_goals AS DOUBLE)),6) ga, round(avg(CASE WHEN home_goals+away_goals>2 THEN 1.0e0 ELSE 0.0e0 END),6) o25 FROM x WHERE rn<=20 GROUP BY 1")
def recent_side_means(spark, d):
    h, a = F.col("home_goals"), F.col("away_goals")
    return st.recent_means(matches(spark, d), "home_team_id", {"gf": h, "ga": a, "o25": (h + a > 2).cast("int")}).select("home_team_id", *r6("gf", "ga", "o25"))


def _mean_sql(name, by, tag, parts):
    cols = ", ".join(f"avg(CAST({e} AS DOUBLE)) {tag}_{k}" for k, e in parts.items())
    return f"{name} AS (SELECT {by}, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY date DESC, match_id DESC) rn FROM matches) WHERE rn<=20 GROUP BY 1)"


def _blend_sql(t, g):
    return f"CASE WHEN {t}>0 AND {g}>0 THEN 0.7*({t})+0.3*({g}) WHEN {t}>0 THEN {t} ELSE {g} END"


_BT, _OV = "CAST(home_goals>0 AND away_goals>0 AS INT)", "CAST(home_goals+away_goals>2 AS INT)"
_CHECK = ", " + ", ".join([
    _mean_sql("hs", "home_team_id", "h", {"gf": "home_goals", "b": _BT, "o": _OV, "c": "home_corners"}),
    _mean_sql("aws", "away_team_id", "a", {"gf": "away_goals", "b": _BT, "o": _OV, "c": "away_corners"}),
    _mean_sql("ls", "league", "l", {"hg": "home_goals", "ag": "away_goals", "b": _BT, "o": _OV, "c": "home_corners+away_corners"}),
    f"q AS (SELECT p.match_id, p.p_h, p.p_d, p.p_a, p_d+0.3 btts, p_h+0.1 over25, p_a+0.2 over15, p_d+0.2 over35, 4+12*p_h ct, p_a+0.3 c75, p_a+0.2 c85, p_a+0.1 c95, {_blend_sql('h_gf', 'l_hg')} ehg, {_blend_sql('a_gf', 'l_ag')} eag, {_blend_sql('(h_b+a_b)/2', 'l_b')} eb, {_blend_sql('(h_o+a_o)/2', 'l_o')} eo, {_blend_sql('(h_c+a_c)', 'l_c')} ec FROM preds p JOIN hs USING (home_team_id) JOIN aws USING (away_team_id) JOIN ls ON ls.league=p.league)",
    "s1 AS (SELECT match_id, p_h, p_d, p_a, over15, over35, c75, c85, c95, CASE WHEN eb>0 AND abs(btts-eb)>0.15 THEN (btts+eb)/2 ELSE btts END btts, CASE WHEN eo>0 AND abs(over25-eo)>0.15 THEN (over25+eo)/2 ELSE over25 END over25, CASE WHEN ec>0 AND abs(ct-ec)/nullif(ec,0)>0.2 THEN 0.4*ct+0.6*ec ELSE ct END ct, CASE WHEN ehg>0 AND eag>0 THEN ehg/eag END r FROM q)",
    "s2 AS (SELECT *, CASE WHEN r>1.8 AND p_h<0.5 THEN least(0.08,(r-1.8)*0.05) ELSE 0 END up, CASE WHEN r<0.55 AND p_a<0.45 THEN least(0.08,(0.55-r)*0.05) ELSE 0 END dn FROM s1)",
    "s3 AS (SELECT *, greatest(0.02,least(0.95,p_h+up-dn/2)) h, greatest(0.02,least(0.5,p_d-(up+dn)/2)) d, greatest(0.02,least(0.95,p_a+dn-up/2)) a FROM s2)",
]) + """ SELECT match_id, round(btts,9) btts, round(over25,9) over25, round(CASE WHEN over15<over25 THEN least(over25*1.2,0.98) ELSE over15 END,9) over15, round(CASE WHEN over35>over25 THEN greatest(over25*0.6,0.02) ELSE over35 END,9) over35, round(ct,9) corner_total,
 round(CASE WHEN ct<7.5 THEN least(0.3,c75*0.6) WHEN ct<9.5 THEN least(0.65,c75) ELSE greatest(0.6,c75) END,9) corner_over75, round(CASE WHEN ct<7.5 THEN least(0.2,c85*0.5) WHEN ct<9.5 THEN least(0.45,c85) ELSE greatest(0.4,c85) END,9) corner_over85, round(CASE WHEN ct<7.5 THEN least(0.1,c95*0.4) WHEN ct<9.5 THEN least(0.25,c95*0.7) ELSE greatest(0.25,c95) END,9) corner_over95,
 round(h/(h+d+a),9) p_h, round(d/(h+d+a),9) p_d, round(a/(h+d+a),9) p_a FROM s3"""


@query(_CHECK)
def market_check(spark, d):
    p = _preds(spark, d)
    given = {"btts": F.col("p_d") + 0.3, "over25": F.col("p_h") + 0.1, "over15": F.col("p_a") + 0.2, "over35": F.col("p_d") + 0.2, "corner_total": 4 + 12 * F.col("p_h"), "corner_over75": F.col("p_a") + 0.3, "corner_over85": F.col("p_a") + 0.2, "corner_over95": F.col("p_a") + 0.1}
    return st.check_markets(p.withColumns(given), matches(spark, d)).select("match_id", *[sql_round(c, 9).alias(c) for c in (*given, "p_h", "p_d", "p_a")])


@query(_RECS + """, k AS (SELECT *, CASE WHEN abs(odds_h-odds_a)*50<50 THEN 'close' WHEN abs(odds_h-odds_a)*50<100 THEN 'slight' WHEN abs(odds_h-odds_a)*50<200 THEN 'clear' ELSE 'strong' END AS kind FROM recs), g AS (SELECT kind, predicted pr, count(*) n, avg(correct) r FROM k GROUP BY 1,2),
 f AS (SELECT k.*, o.n, o.r, CASE WHEN predicted='H' THEN -1 WHEN coalesce(h.n,0)>=10 THEN h.r ELSE p_h END ah, CASE WHEN predicted='D' THEN -1 WHEN coalesce(dd.n,0)>=10 THEN dd.r ELSE p_d END ad, CASE WHEN predicted='A' THEN -1 WHEN coalesce(aa.n,0)>=10 THEN aa.r ELSE p_a END aw FROM k JOIN g o ON o.kind=k.kind AND o.pr=predicted
  LEFT JOIN g h ON h.kind=k.kind AND h.pr='H' LEFT JOIN g dd ON dd.kind=k.kind AND dd.pr='D' LEFT JOIN g aa ON aa.kind=k.kind AND aa.pr='A'),
 z AS (SELECT *, CASE WHEN n>=50 AND r<0.4 AND confidence<=0.65 AND greatest(ah,ad,aw)-r>=0.1 THEN CASE WHEN ah=greatest(ah,ad,aw) THEN 'H' WHEN ad=greatest(ah,ad,aw) THEN 'D' ELSE 'A' END END flip FROM f),
 m AS (SELECT match_id, flip, p_h + CASE WHEN flip IS NULL THEN 0 WHEN flip='H' THEN 0.15 ELSE -0.075 END h, p_d + CASE WHEN flip IS NULL THEN 0 WHEN flip='D' THEN 0.15 ELSE -0.075 END d, p_a + CASE WHEN flip IS NULL THEN 0 WHEN flip='A' THEN 0.15 ELSE -0.075 END a FROM z)
 SELECT match_id, flip, round(h/(h+d+a),6) p_h, round(d/(h+d+a),6) p_d, round(a/(h+d+a),6) p_a FROM m""")
def weak_flips(spark, d):
    made = st.flips(_recs(spark, d), fn.match_type((F.col("odds_h") - F.col("odds_a")) * 50))
    return made.select("match_id", "flip", *r6("p_h", "p_d", "p_a"))


@query(""", log AS (SELECT user_id%10 model_id, CAST(event_id%50 AS BIGINT) AS version, ts, event_id, CASE WHEN value<20 THEN 'staging' WHEN value<40 THEN 'production' ELSE 'candidate' END s FROM events), s AS (SELECT model_id, version, min((ts, event_id)) f FROM log WHERE s='staging' GROUP BY 1,2),
 u AS (SELECT l.model_id, l.version, min((l.ts, l.event_id)) up FROM log l JOIN s ON s.model_id=l.model_id AND s.version=l.version WHERE l.s='production' AND (l.ts, l.event_id) > s.f GROUP BY 1,2), k AS (SELECT DISTINCT model_id, version FROM log), t AS (SELECT model_id, max(up) m FROM u GROUP BY 1)
 SELECT k.model_id, k.version, CASE WHEN u.up=t.m THEN 'production' WHEN u.up IS NOT NULL THEN 'archived' WHEN s.f IS NOT NULL THEN 'staging' ELSE 'candidate' END status FROM k LEFT JOIN s ON s.model_id=k.model_id AND s.version=k.version LEFT JOIN u ON u.model_id=k.model_id AND u.version=k.version LEFT JOIN t ON t.model_id=k.model_id""")
def registry_states(spark, d):
    v = F.col("value")
    log = table(spark, d, "events").select((F.col("user_id") % 10).alias("model_id"), (F.col("event_id") % 50).cast("long").alias("version"), F.col("ts").alias("at"), "event_id", F.when(v < 20, "staging").when(v < 40, "production").otherwise("candidate").alias("to_status"))
    return st.registry_states(log)


@query(", x AS (SELECT CAST(result='H' AS INT) y, least(greatest(floor((p_h-0.25)/0.05+1e-9),-1),10) k FROM preds), t AS (SELECT i, round(0.25+i*0.05,6) AS threshold FROM range(11) r(i)), g AS (SELECT CAST(threshold AS DOUBLE) threshold, CAST(sum(CASE WHEN k>=i THEN y ELSE 0 END) AS BIGINT) tp, CAST(sum(CASE WHEN k>=i THEN 1 ELSE 0 END) AS BIGINT) picks, sum(y) pos FROM x, t GROUP BY 1), f AS (SELECT *, round(2.0e0*tp/nullif(picks+pos,0),6) f1 FROM g) SELECT threshold, tp, picks, f1, row_number() OVER (ORDER BY f1 DESC, threshold)=1 best FROM f")
def best_threshold(spark, d):
    return fitted.best_threshold(_preds(spark, d).withColumn("y", (F.col("result") == "H").cast("int")), "y", "p_h")


@query()
def dixon_coles_strengths(spark, d):
    made = fitted.dixon_coles(matches(spark, d))
    return made.select("league", "team", *r6("attack", "defence", "base", "home", "rho"), "n")


@query()
def dixon_coles_rates(spark, d):
    m = matches(spark, d)
    return fitted.rolling_rates(m, m.where("season >= 1997")).select("match_id", *r6("lh", "la"))


@query()
def calibration_choice(spark, d):
    p = _preds(spark, d).withColumn("y", (F.col("result") == "H").cast("int"))
    return fitted.best_calibration(p.where("season < 1997"), p.where("season >= 1997"), "y", "p_h").select("method", *r6("log_loss"), "chosen")


@query()
def result_classes(spark, d):
    p = _preds(spark, d).withColumn("y", F.when(F.col("result") == "H", 0).when(F.col("result") == "D", 1).otherwise(2))
    made = fitted.result_model(p.where("season < 1997"), p.where("season >= 1997"), ["odds_h", "odds_d", "odds_a"], "y")
    return made.select("match_id", *[F.round(F.get("probabilities", F.lit(i)), 6).alias(f"p{i}") for i in range(3)])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
