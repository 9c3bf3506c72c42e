"""Registered queries of features, decisions, reports and matching, with their SQL twins. Figures compare at nine digits."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import functions as fn
from touchline.operators import decisions as dec
from touchline.operators import evaluation as ev
from touchline.operators import features as ft
from touchline.operators import feedback as fb
from touchline.operators import joins as jn
from touchline.operators import matching as mt
from touchline.operators import models
from touchline.operators import reports as rp
from touchline.operators import windows as win
from touchline.plans.matches import matches, predictions
from touchline.plans.queries import _BR, _FACT, _HIT, _PICK, _PR, _RECS, T, query
from touchline.session import table


def _long(spark, d):
    return win.long_view(matches(spark, d))


def _preds(spark, d):
    return predictions(matches(spark, d))


def _recs(spark, d):
    return fb.records(_preds(spark, d))


def r9(*names: str) -> list:
    return [(F.round(F.col(n).cast("double"), 9) + F.lit(0.0)).alias(n) for n in names]  # no negative zero


def s9(**parts: str) -> str:
    return ", ".join(f"round(CAST({v} AS DOUBLE),9)+0.0e0 {k}" for k, v in parts.items())


# fixtures with both sides' form: what the feature projections read
_PRE = f""", f5 AS (SELECT match_id, is_home, avg(CAST(gf AS DOUBLE)) OVER w gf_5, avg(CAST(ga AS DOUBLE)) OVER w ga_5, avg(CAST(pts AS DOUBLE)) OVER w pts_5 FROM lp WINDOW w AS ({T} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
 pre AS (SELECT m.*, h.gf_5 home_gf_5, h.ga_5 home_ga_5, h.pts_5 home_pts_5, a.gf_5 away_gf_5, a.ga_5 away_ga_5, a.pts_5 away_pts_5, 1400+40*odds_a home_elo, 1400+40*odds_h away_elo, 1450+25*home_corners home_attack_elo, 1450+25*away_corners away_attack_elo,
  1500-10*home_corners home_defence_elo, 1500-10*away_corners away_defence_elo, 1/odds_h mkt_home_prob, CASE WHEN m.match_id%4<>0 THEN 1/odds_d END mkt_draw_prob, 0.5e0 mkt_over25_prob, 0.45e0 lg_over25_rate, CASE WHEN m.match_id%3<>0 THEN 0.6e0 END h2h_btts, 0.5e0 lg_btts_rate
  FROM matches m JOIN f5 h ON h.match_id=m.match_id AND h.is_home=1 JOIN f5 a ON a.match_id=m.match_id AND a.is_home=0)"""


def _pre(spark, d):
    m = matches(spark, d)
    made = win.both_sides(m, win.form(win.long_view(m), 5), ("gf_5", "ga_5", "pts_5"))
    return made.withColumns({
        "home_elo": 1400 + 40 * F.col("odds_a"), "away_elo": 1400 + 40 * F.col("odds_h"), "home_attack_elo": 1450 + 25 * F.col("home_corners"), "away_attack_elo": 1450 + 25 * F.col("away_corners"),
        "home_defence_elo": 1500 - 10 * F.col("home_corners"), "away_defence_elo": 1500 - 10 * F.col("away_corners"), "mkt_home_prob": 1 / F.col("odds_h"), "mkt_draw_prob": F.when(F.col("match_id") % 4 != 0, 1 / F.col("odds_d")),
        "mkt_over25_prob": F.lit(0.5), "lg_over25_rate": F.lit(0.45), "h2h_btts": F.when(F.col("match_id") % 3 != 0, 0.6), "lg_btts_rate": F.lit(0.5),
    })


@query(_PRE + " SELECT match_id, " + s9(home_gf_5="home_gf_5", home_ga_5="home_ga_5", away_gf_5="away_gf_5", away_pts_5="away_pts_5") + " FROM pre")
def form_both_sides(spark, d):
    return _pre(spark, d).select("match_id", *r9("home_gf_5", "home_ga_5", "away_gf_5", "away_pts_5"))


_C = lambda c, v=0: f"coalesce({c},{v})"
_ATT, _DEF = {s: f"({_C(f'{s}_gf_5')}*{s}_attack_elo/1500.0e0)" for s in ("home", "away")}, {s: f"({_C(f'{s}_ga_5')}*{s}_defence_elo/1500.0e0)" for s in ("home", "away")}
_RATE = {s: f"({_C(f'{s}_gf_5')}/({_C(f'{s}_ga_5', 1)}+0.1e0))" for s in ("home", "away")}


@query(_PRE + " SELECT match_id, " + s9(elo_diff="home_elo-away_elo", form_diff=f"{_C('home_pts_5')}-{_C('away_pts_5')}", gf_diff_abs=f"abs({_C('home_gf_5')}-{_C('away_gf_5')})", ga_diff=f"{_C('home_ga_5')}-{_C('away_ga_5')}", home_attack_power=_ATT["home"], away_defence_power=_DEF["away"], attack_defence_ratio=f"({_ATT['home']}+{_ATT['away']})/({_DEF['home']}+{_DEF['away']}+0.1e0)", scoring_rate_diff=f"{_RATE['home']}-{_RATE['away']}")
       + f", CAST({_C('home_gf_5')}>1.0 AND {_C('away_gf_5')}>1.0 AS INT) both_attack_strong, CAST({_C('home_ga_5')}>1.2e0 AND {_C('away_ga_5')}>1.2e0 AS INT) both_defence_weak, CAST({_C('home_gf_5')}+{_C('away_gf_5')}>2.5 AS INT) high_scoring, CAST({_C('home_gf_5')}+{_C('away_gf_5')}<1.5 AS INT) low_scoring, CAST(abs(home_elo-away_elo)<30 AS INT) teams_even, CAST(abs(home_elo-away_elo)<15 AS INT) very_even FROM pre")
def interaction_features(spark, d):
    made = ft.interactions(_pre(spark, d))
    return made.select("match_id", *r9("elo_diff", "form_diff", "gf_diff_abs", "ga_diff", "home_attack_power", "away_defence_power", "attack_defence_ratio", "scoring_rate_diff"), "both_attack_strong", "both_defence_weak", "high_scoring", "low_scoring", "teams_even", "very_even")


_EH = "(1/(1+pow(10.0e0,-(home_elo-away_elo+50)/400.0e0)))"


@query(_PRE + ", sz AS (SELECT league, greatest(least(count(*)/3000.0e0,1.0e0),0.2e0) wt FROM matches GROUP BY 1) SELECT match_id, " + s9(
    mkt_home_misalign=f"coalesce({_EH}-mkt_home_prob,0)", mkt_draw_mismatch=f"coalesce(mkt_draw_prob-(1-abs(2*{_EH}-1)*0.8e0),0)", mkt_over_misalign="lg_over25_rate-mkt_over25_prob", home_gf_per_ga="coalesce(home_gf_5/(home_ga_5+0.5e0),1)", away_attack_ratio="coalesce(away_gf_5/(away_gf_5+away_ga_5+0.1e0),1)",
    form_pts_diff="home_pts_5/5.0e0-away_pts_5/5.0e0", btts_signal="coalesce(h2h_btts,lg_btts_rate)*0.5e0+lg_btts_rate*0.5e0", overall_diff="(home_elo+home_attack_elo/10.0e0+home_pts_5/5.0e0*50)-(away_elo+away_attack_elo/10.0e0+away_pts_5/5.0e0*50)", lg_confidence_weight="wt") + " FROM pre JOIN sz ON sz.league=pre.league")
def enhanced_features(spark, d):
    return ft.enhanced(_pre(spark, d)).select("match_id", *r9("mkt_home_misalign", "mkt_draw_mismatch", "mkt_over_misalign", "home_gf_per_ga", "away_attack_ratio", "form_pts_diff", "btts_signal", "overall_diff", "lg_confidence_weight"))


_XG = ", x AS (SELECT match_id, CASE WHEN match_id%3<>0 THEN home_corners*0.6e0 END hx, CASE WHEN match_id%5<>0 THEN away_corners*0.6e0 END ax, home_goals+away_goals tg, least(home_goals,1) hh, least(away_goals,1) ha FROM matches), y AS (SELECT *, hx IS NULL OR ax IS NULL px, coalesce(hx,0) h, coalesce(ax,0) a FROM x)"


@query(_XG + " SELECT match_id, CAST(px AS INT) xg_is_proxy, " + s9(xg_diff_real="h-a", home_score_prob="CASE WHEN px THEN 0.5 ELSE 1/(1+exp(-1.5e0*(h-1))) END", btts_xprob="CASE WHEN px THEN 0.25 ELSE 1/(1+exp(-1.5e0*(h-1)))*(1/(1+exp(-1.5e0*(a-1)))) END", over25_xprob="CASE WHEN px THEN 0.5 ELSE 1-exp(-0.8e0*(h+a)) END", draw_xprob="1/(1+3*abs(h-a))") + " FROM y")
def xg_features(spark, d):
    m = matches(spark, d).select("match_id", F.when(F.col("match_id") % 3 != 0, F.col("home_corners") * 0.6).alias("home_xg"), F.when(F.col("match_id") % 5 != 0, F.col("away_corners") * 0.6).alias("away_xg"))
    return ft.xg_features(m).select("match_id", "xg_is_proxy", *r9("xg_diff_real", "home_score_prob", "btts_xprob", "over25_xprob", "draw_xprob"))


@query(_XG + " SELECT match_id, hh+ha ht_total_goals, CAST(hh=ha AS INT) ht_result_is_draw, CAST(hh>ha AS INT) ht_home_leading, round(2.6e0*0.45e0,9) ht_second_half_expected, greatest(tg-hh-ha,0) second_half_goals FROM y")
def half_time_features(spark, d):
    m = matches(spark, d).withColumns({"ht_home_goals": F.least("home_goals", F.lit(1)), "ht_away_goals": F.least("away_goals", F.lit(1)), "lg_avg_goals": F.lit(2.6)})
    return ft.half_time(m).select("match_id", "ht_total_goals", "ht_result_is_draw", "ht_home_leading", *r9("ht_second_half_expected"), "second_half_goals")


@query(_PRE + ", m AS (SELECT avg(home_gf_5) g FROM pre) SELECT match_id, " + s9(home_gf_5="coalesce(home_gf_5, CASE WHEN match_id%2=0 THEN 1.3e0 END, g, 0)", data_completeness="1-(CAST(home_gf_5 IS NULL AS INT)+CAST(away_gf_5 IS NULL AS INT)+CAST(mkt_draw_prob IS NULL AS INT))/3.0e0") + " FROM pre, m")
def tiered_fill(spark, d):
    from touchline.operators.aggregates import completeness

    p = completeness(_pre(spark, d), ["home_gf_5", "away_gf_5", "mkt_draw_prob"]).withColumn("base", F.when(F.col("match_id") % 2 == 0, 1.3))
    return ft.tiered_fill(p, {"home_gf_5": ("base",)}, {"home_gf_5": 0.0}).select("match_id", *r9("home_gf_5", "data_completeness"))


@query(""" SELECT match_id, CAST(away_goals=0 AS INT) home_clean_sheet, CAST(home_goals=0 AS INT) away_clean_sheet, CAST(home_goals>1 AS INT) home_over15, CAST(home_goals>0 AS INT) home_over05, CAST(away_goals>0 AS INT) away_over05, CAST(home_goals+away_goals BETWEEN 2 AND 3 AS INT) goals_2_3, CAST(home_goals+away_goals<=1 AS INT) goals_0_1, CAST(home_goals+away_goals>=4 AS INT) goals_4_plus, CAST(home_goals>away_goals AS INT) home_win, CAST(home_goals=away_goals AS INT) is_draw FROM matches""")
def market_targets_ten(spark, d):
    return matches(spark, d).select("match_id", *[c.alias(k) for k, c in ft.market_targets_more(F.col("home_goals"), F.col("away_goals")).items()])


@query(""", x AS (SELECT match_id, home_goals h, away_goals a, least(home_goals,1) hh, least(away_goals,1) ha FROM matches) SELECT match_id, CAST(hh>ha AS INT) ht_home, CAST(hh=ha AS INT) ht_draw, CAST(hh<ha AS INT) ht_away, CAST(hh+ha>0 AS INT) ht_over05, CAST(hh+ha>1 AS INT) ht_over15, CAST(hh>0 AND ha>0 AS INT) ht_btts, CAST(h+a-hh-ha>0 AS INT) second_over05, CAST(h+a-hh-ha>1 AS INT) second_over15,
 CAST(h>hh AND a>ha AS INT) second_btts, CAST(h+a-hh-ha>hh+ha AS INT) second_more, CAST(hh=ha AND h>a AS INT) ht_ft_dh, CAST(hh=ha AND h<a AS INT) ht_ft_da, CAST(h-1>a AS INT) handicap_home, CAST(h-1<a AS INT) handicap_away, CAST(abs(h-a)=1 AS INT) win_by_one, CAST(hh>ha OR (hh=ha AND h>a) AS INT) first_goal_home FROM x""")
def half_targets(spark, d):
    h, a = F.col("home_goals"), F.col("away_goals")
    return matches(spark, d).select("match_id", *[c.alias(k) for k, c in ft.half_targets(h, a, F.least(h, F.lit(1)), F.least(a, F.lit(1))).items()])


@query(_PRE + """ SELECT match_id, CASE WHEN abs(home_elo-away_elo)<30 THEN 'derby' WHEN abs(home_elo-away_elo)<100 THEN 'nearly_even' WHEN abs(home_elo-away_elo)<200 THEN 'slight_favourite' WHEN home_elo>1700 OR away_elo>1700 THEN 'big_match' ELSE 'clear_favourite' END five,
 CASE WHEN home_elo-away_elo<50 THEN 'close' WHEN home_elo-away_elo<150 THEN 'slight' WHEN home_elo-away_elo<300 THEN 'clear' ELSE 'dominant' END || '_' || CASE WHEN home_elo<1400 THEN 'weak' WHEN home_elo<1600 THEN 'mid' ELSE 'strong' END level FROM pre""")
def match_types(spark, d):
    p, h, a = _pre(spark, d), F.col("home_elo"), F.col("away_elo")
    return p.select("match_id", ft.five_types(h - a, h, a).alias("five"), ft.type_and_level(h - a, h).alias("level"))


@query(", g AS (SELECT league, avg(CASE WHEN home_goals=away_goals THEN 1.0e0 ELSE 0.0e0 END) r FROM matches GROUP BY 1) SELECT league, round(r,9) draw_rate, CASE WHEN r<=0.22e0 THEN 0 WHEN r<=0.25e0 THEN 1 WHEN r<=0.28e0 THEN 2 ELSE 3 END draw_group FROM g")
def draw_groups(spark, d):
    return ft.draw_groups(matches(spark, d)).select("league", *r9("draw_rate"), "draw_group")


@query(", c AS (SELECT DISTINCT c_mktsegment v FROM customer WHERE c_mktsegment IS NOT NULL), r AS (SELECT v, row_number() OVER (ORDER BY v)-1 code FROM c) SELECT c_custkey, CAST(coalesce(code,-1) AS BIGINT) code FROM customer LEFT JOIN r ON v=c_mktsegment")
def category_codes(spark, d):
    return ft.category_codes(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "code").select("c_custkey", F.col("code").cast("long").alias("code"))


@query(", l AS (SELECT match_id, date FROM matches ORDER BY date DESC, match_id DESC LIMIT 75) SELECT match_id FROM l ORDER BY date, match_id LIMIT 25")
def results_page(spark, d):
    return ft.page(matches(spark, d).select("match_id", "date"), ["date", "match_id"], 25, 2).select("match_id")


@query(", n AS (SELECT r_name || ' ' || n_name x FROM nation JOIN region ON r_regionkey=n_regionkey) SELECT split_part(x,' ',1) country, count(*) n, string_agg(trim(substring(x, length(split_part(x,' ',1))+1)), ', ' ORDER BY trim(substring(x, length(split_part(x,' ',1))+1))) AS names FROM n GROUP BY 1")
def grouped_names(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return ft.grouped_names(n.select(F.concat("r_name", F.lit(" "), "n_name").alias("x")), "x")


@query(", b AS (SELECT league FROM matches GROUP BY 1 HAVING count(*)>=3000) SELECT match_id, league FROM matches WHERE league IN (SELECT league FROM b)")
def big_leagues(spark, d):
    return ft.big_groups(matches(spark, d), "league", 3000).select("match_id", "league")


@query(", b AS (SELECT league, count(*) n, avg(CAST(home_goals+away_goals AS DOUBLE)) g, avg(CASE WHEN home_goals>away_goals THEN 1.0e0 ELSE 0.0e0 END) h FROM matches GROUP BY 1) SELECT match_id, round(CASE WHEN n>=3000 THEN g ELSE 2.6 END,9) base_goals, round(CASE WHEN n>=3000 THEN h ELSE 0.45 END,9) base_home FROM matches m JOIN b ON b.league=m.league")
def league_baselines_joined(spark, d):
    return ft.with_baselines(matches(spark, d), 3000).select("match_id", *r9("base_goals", "base_home"))


@query(""", n AS (SELECT team, max(season) s FROM lp GROUP BY 1), c AS (SELECT lp.team, league, count(*) c FROM lp JOIN n ON n.team=lp.team AND season=s GROUP BY 1,2), l AS (SELECT team, league FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY c DESC, league) rn FROM c) WHERE rn=1),
 f AS (SELECT team, string_agg(CASE WHEN gf>ga THEN 'W' WHEN gf=ga THEN 'D' ELSE 'L' END, '' ORDER BY rn) form10 FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date DESC, match_id DESC) rn FROM lp) WHERE rn<=10 GROUP BY 1),
 p AS (SELECT team, count(*) n, round(avg(CAST(gf AS DOUBLE)),9) gf, round(avg(CAST(pts AS DOUBLE)),9) pts, arg_max(cf, (date, match_id)) cf FROM lp GROUP BY 1) SELECT p.*, league, form10 FROM p JOIN l ON l.team=p.team JOIN f ON f.team=p.team""")
def team_index(spark, d):
    return ft.team_index(_long(spark, d), "cf").select("team", "n", *r9("gf", "pts"), "cf", "league", "form10")


@query(""", s AS (SELECT team, max(CASE WHEN is_home=1 THEN (date, match_id) END) h, max(CASE WHEN is_home=0 THEN (date, match_id) END) a, arg_max(gf, CASE WHEN is_home=1 THEN (date, match_id) END) hg, arg_max(gf, CASE WHEN is_home=0 THEN (date, match_id) END) ag, arg_max(cf, CASE WHEN is_home=1 THEN (date, match_id) END) hc, arg_max(cf, CASE WHEN is_home=0 THEN (date, match_id) END) ac FROM lp GROUP BY 1)
 SELECT team, CASE WHEN a IS NULL OR h>=a THEN coalesce(nullif(hg,0),nullif(ag,0),hg,ag) ELSE coalesce(nullif(ag,0),nullif(hg,0),ag,hg) END gf, CASE WHEN a IS NULL OR h>=a THEN coalesce(nullif(hc,0),nullif(ac,0),hc,ac) ELSE coalesce(nullif(ac,0),nullif(hc,0),ac,hc) END cf FROM s""")
def form_cache(spark, d):
    return ft.form_cache(_long(spark, d), ("gf", "cf"))


@query(", x AS (SELECT match_id, date, date_diff('day', DATE '1998-03-01', CAST(date AS DATE)) k FROM matches) SELECT 'finished' kind, match_id FROM (SELECT * FROM x WHERE k BETWEEN -7 AND 0 ORDER BY date DESC, match_id DESC LIMIT 50) UNION ALL SELECT 'live', match_id FROM (SELECT * FROM x WHERE abs(k)<=3 ORDER BY abs(k), date, match_id LIMIT 50) UNION ALL SELECT 'upcoming', match_id FROM (SELECT * FROM x WHERE k>=0 ORDER BY date, match_id LIMIT 50)")
def fixture_windows(spark, d):
    m = matches(spark, d).select("match_id", "date")
    parts = [ft.fixture_window(m, k, "1998-03-01").select(F.lit(k).alias("kind"), "match_id") for k in ("finished", "live", "upcoming")]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"SELECT match_id, team, " + s9(gf_now="avg(CAST(gf AS DOUBLE)) OVER w", ga_now="avg(CAST(ga AS DOUBLE)) OVER w") + " FROM lp WINDOW w AS (PARTITION BY league, team, is_home ORDER BY date, match_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def form_with_current(spark, d):
    return win.current_form(_long(spark, d)).select("match_id", "team", F.round("gf_now_5", 9).alias("gf_now"), F.round("ga_now_5", 9).alias("ga_now"))


@query(""", r AS (SELECT match_id, count(*) OVER w n, coalesce(sum(home_goals) OVER w,0) h, coalesce(sum(away_goals) OVER w,0) a, coalesce(sum(CAST(home_goals=away_goals AS INT)) OVER w,0) dr FROM matches WINDOW w AS (PARTITION BY league ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT *, greatest(n,1)*1.0e0 k FROM r)
 SELECT match_id, round(h/k+a/k,12) lg_strength, round(h/k-a/k,12) lg_home_adv, round(dr/k,12) lg_draw_rate, round((h+a)/k,12) lg_total_goals FROM g""")
def league_factors(spark, d):
    names = ("lg_strength", "lg_home_adv", "lg_draw_rate", "lg_total_goals")
    return win.league_factors(matches(spark, d)).select("match_id", *[F.round(c, 12).alias(c) for c in names])


@query(""", x AS (SELECT *, least(home_team_id,away_team_id) lo, greatest(home_team_id,away_team_id) hi, row_number() OVER (PARTITION BY league, least(home_team_id,away_team_id), greatest(home_team_id,away_team_id) ORDER BY date, match_id) rn FROM matches)
 SELECT a.match_id, """ + s9(h2h20_home="coalesce(avg(CASE WHEN b.match_id IS NULL THEN NULL WHEN (b.home_team_id=a.home_team_id AND b.home_goals>b.away_goals) OR (b.away_team_id=a.home_team_id AND b.away_goals>b.home_goals) THEN 1.0 ELSE 0.0 END),0.45)", h2h20_draw="coalesce(avg(CASE WHEN b.match_id IS NULL THEN NULL WHEN b.home_goals=b.away_goals THEN 1.0 ELSE 0.0 END),0.25)", h2h20_away="coalesce(avg(CASE WHEN b.match_id IS NULL THEN NULL WHEN (b.home_team_id=a.home_team_id AND b.home_goals<b.away_goals) OR (b.away_team_id=a.home_team_id AND b.away_goals<b.home_goals) THEN 1.0 ELSE 0.0 END),0.30)", h2h20_goals="coalesce(avg(CAST(b.home_goals+b.away_goals AS DOUBLE)),2.5)", h2h20_btts="coalesce(avg(CASE WHEN b.match_id IS NULL THEN NULL WHEN b.home_goals>0 AND b.away_goals>0 THEN 1.0 ELSE 0.0 END),0.5)") + " FROM x a LEFT JOIN x b ON a.league=b.league AND a.lo=b.lo AND a.hi=b.hi AND b.rn BETWEEN a.rn-20 AND a.rn-1 GROUP BY 1")
def head_to_head20(spark, d):
    return win.head_to_head_last20(matches(spark, d)).select("match_id", *r9("h2h20_home", "h2h20_draw", "h2h20_away", "h2h20_goals", "h2h20_btts"))


@query(", x AS (SELECT *, CASE WHEN gf>ga THEN 'W' WHEN gf=ga THEN 'D' ELSE 'L' END m, row_number() OVER (PARTITION BY league, team ORDER BY date DESC, match_id DESC) rn FROM lp), n AS (SELECT league, team, m result FROM x WHERE rn=1) SELECT x.league, x.team, result, coalesce(min(CASE WHEN m<>result THEN rn END)-1, count(*)) length FROM x JOIN n ON n.league=x.league AND n.team=x.team GROUP BY 1,2,3")
def current_streaks(spark, d):
    return win.current_streak(_long(spark, d))


@query(f"SELECT match_id, team, (lag(gf-ga,3) OVER ({T})) - ((lag(gf-ga,1) OVER ({T})) + (lag(gf-ga,2) OVER ({T})))/2.0 momentum FROM lp")
def momentum_published(spark, d):
    return win.momentum_reference(_long(spark, d)).select("match_id", "team", "momentum")


@query(f"SELECT match_id, team, CASE WHEN count(gf) OVER w>=3 THEN round(avg(CAST(gf AS DOUBLE)) OVER w,9) END gf_5, CASE WHEN count(ga) OVER w>=3 THEN round(avg(CAST(ga AS DOUBLE)) OVER w,9) END ga_5 FROM lp WINDOW w AS ({T} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def form_min_periods(spark, d):
    return win.form(_long(spark, d), 5, ("gf", "ga"), least=3).select("match_id", "team", *r9("gf_5", "ga_5"))


@query("SELECT match_id, " + ", ".join(f"CASE WHEN count(*) OVER w>=50 THEN round(avg(CASE WHEN {c} THEN 1.0e0 ELSE 0.0e0 END) OVER w,12) END {n}" for n, c in (("lg_home", "home_goals>away_goals"), ("lg_over25", "home_goals+away_goals>2"))) + " FROM matches WINDOW w AS (PARTITION BY league ORDER BY date, match_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)")
def league_rolling_published(spark, d):
    made = win.league_baseline(matches(spark, d), 200, 50, with_current=True)
    return made.select("match_id", *[F.round(c, 12).alias(c) for c in ("lg_home", "lg_over25")])


_STATUS = ", s(k, raw) AS (VALUES (0,'NS'),(1,'TBD'),(2,'PST'),(3,'1H'),(4,'HT'),(5,'2H'),(6,'ET'),(7,'BT'),(8,'P'),(9,'LIVE'),(10,'FT'),(11,'AET'),(12,'PEN'),(13,'SUSP'),(14,'INT'),(15,'ABD'),(16,'CANC'),(17,'POST'),(18,'WO'))"


@query(_STATUS + " SELECT match_id, CASE WHEN raw IN ('NS','TBD','PST') THEN 'NS' WHEN raw IN ('1H','HT','2H','ET','BT','P') THEN 'LIVE' WHEN raw IN ('FT','AET','PEN') THEN 'FT' WHEN raw IN ('SUSP','INT') THEN 'SUSP' WHEN raw IN ('ABD','CANC') THEN 'ABD' WHEN raw='POST' THEN 'POST' ELSE 'UNKNOWN' END status FROM matches JOIN s ON k=match_id%19")
def status_codes(spark, d):
    raw = "NS TBD PST 1H HT 2H ET BT P LIVE FT AET PEN SUSP INT ABD CANC POST WO".split()
    return matches(spark, d).select("match_id", fn.status_code(F.get(F.array(*[F.lit(x) for x in raw]), (F.col("match_id") % 19).cast("int"))).alias("status"))


@query(""", s AS (SELECT match_id, date, home_team_id h, away_team_id a, CASE WHEN home_corners>0 THEN home_corners END hc, CASE WHEN away_corners>1 THEN away_corners END ac, CAST(NULL AS DOUBLE) xg, 3 prio FROM matches UNION ALL SELECT match_id+10000000, date, home_team_id, away_team_id, NULL, NULL, 1.5e0, 3 FROM matches WHERE match_id%2=0),
 r AS (SELECT match_id, row_number() OVER (PARTITION BY CAST(date AS DATE), h, a ORDER BY prio, CAST(hc IS NOT NULL AS INT)+CAST(ac IS NOT NULL AS INT)+CAST(xg IS NOT NULL AS INT)+2*CAST(xg IS NOT NULL AS INT) DESC, match_id) rn FROM s) SELECT match_id FROM r WHERE rn=1""")
def dedup_xg(spark, d):
    m = matches(spark, d).select("match_id", "date", F.col("home_team_id").cast("string").alias("home_team"), F.col("away_team_id").cast("string").alias("away_team"), "home_goals", "away_goals", F.when(F.col("home_corners") > 0, F.col("home_corners")).alias("hc"), F.when(F.col("away_corners") > 1, F.col("away_corners")).alias("ac"))
    more = m.where("match_id % 2 = 0").drop("hc", "ac").withColumn("match_id", F.col("match_id") + 10_000_000).withColumn("xg", F.lit(1.5))
    return jn.dedup_by_priority(jn.unify([m, more]).withColumn("source", F.lit("HF")), ["hc", "ac", "xg"], "xg").select("match_id")


@query("SELECT min(match_id) one, count(*) n, 0 k FROM matches WHERE match_id IN (SELECT match_id FROM matches WHERE home_goals>2 INTERSECT SELECT match_id FROM matches WHERE away_goals>1) UNION ALL SELECT min(match_id), count(*), 1 FROM (SELECT match_id FROM matches WHERE home_goals>2 EXCEPT SELECT match_id FROM matches WHERE away_goals>1)")
def id_sets(spark, d):
    m = matches(spark, d).select("match_id", "home_goals", "away_goals")
    a, b = m.where("home_goals > 2").select("match_id"), m.where("away_goals > 1").select("match_id")
    size = lambda df, k: df.agg(F.min("match_id").alias("one"), F.count("*").alias("n")).withColumn("k", F.lit(k))
    return size(a.intersect(b), 0).union(size(a.subtract(b), 1))


# decisions


def _pmf_sql(rate):
    return f"exp(-({rate}))*pow({rate},k)/{_FACT}"


@query(f", r AS (SELECT match_id, 2+p_h lh, 1+p_a la FROM preds), g AS (SELECT CAST(i AS INT) k FROM range(5) t(i)), h AS (SELECT match_id, k, {_pmf_sql('lh')} p FROM r, g), a AS (SELECT match_id, k, {_pmf_sql('la')} p FROM r, g), t AS (SELECT h.match_id, h.k+a.k k, sum(h.p*a.p) p FROM h JOIN a ON a.match_id=h.match_id WHERE h.k+a.k<=4 GROUP BY 1,2) SELECT match_id, round(1-sum(CASE WHEN k<=2 THEN p ELSE 0 END),9) over25, round(1-sum(CASE WHEN k<=3 THEN p ELSE 0 END),9) over35, round(1-sum(p),9) over45 FROM t GROUP BY 1")
def count_markets(spark, d):
    r = _preds(spark, d).select("match_id", (2 + F.col("p_h")).alias("lh"), (1 + F.col("p_a")).alias("la"))
    return dec.count_overs(r, "lh", "la", (2, 3, 4)).select("match_id", *r9("over25", "over35", "over45"))


@query(", r AS (SELECT match_id, 2+p_h m, 1+p_a n, 4.0e0 s FROM preds), x AS (SELECT match_id, pow(s/(m+s),s) h0, pow(s/(m+s),s)*s*(m/(m+s)) h1, pow(s/(m+s),s)*s*(s+1)/2*pow(m/(m+s),2) h2, pow(s/(n+s),s) a0, pow(s/(n+s),s)*s*(n/(n+s)) a1, pow(s/(n+s),s)*s*(s+1)/2*pow(n/(n+s),2) a2 FROM r) SELECT match_id, round(1-h0*a0-h0*a1-h1*a0,9) over15, round(1-h0*a0-h0*a1-h1*a0-h0*a2-h1*a1-h2*a0,9) over25 FROM x")
def count_markets_spread(spark, d):
    r = _preds(spark, d).select("match_id", (2 + F.col("p_h")).alias("lh"), (1 + F.col("p_a")).alias("la"))
    return dec.count_overs(r, "lh", "la", (1, 2), spread=4.0).select("match_id", *r9("over15", "over25"))


@query(", r AS (SELECT *, 0.7e0+2*p_h+2*p_a t FROM preds) SELECT match_id, " + s9(over15="0.5e0*(p_h+0.3e0)+0.5e0*(1-exp(-t)*(1+t))", over25="0.6e0*(p_h+0.1e0)+0.4e0*(1-exp(-t)*(1+t+t*t/2))", over35="0.6e0*p_a+0.4e0*(1-exp(-t)*(1+t+t*t/2+t*t*t/6))", corner_mean="greatest(7,least(14,0.6e0*(6+8*p_h)+0.4e0*9.5e0))") + " FROM r")
def blended_overs(spark, d):
    p = _preds(spark, d).withColumns({"ml_over15": F.col("p_h") + 0.3, "ml_over25": F.col("p_h") + 0.1, "ml_over35": F.col("p_a")})
    return dec.blended_overs(p, 0.7 + 2 * F.col("p_h") + 2 * F.col("p_a"), 6 + 8 * F.col("p_h"), F.lit(9.5)).select("match_id", *r9("over15", "over25", "over35", "corner_mean"))


@query(", r AS (SELECT match_id, 0.4e0+2*p_h h, 0.3e0+2*p_a a FROM preds) SELECT match_id, " + s9(over15="1-exp(-(h+a))*(1+h+a)", over25="1-exp(-(h+a))*(1+(h+a)+(h+a)*(h+a)/2)", btts="1-exp(-h)-exp(-a)+exp(-h-a)") + " FROM r")
def closed_form_totals(spark, d):
    made = models.closed_form_totals(0.4 + 2 * F.col("p_h"), 0.3 + 2 * F.col("p_a"))
    return _preds(spark, d).select("match_id", *[F.round(made[k], 9).alias(k) for k in ("over15", "over25", "btts")])


_GRID3 = f", r AS (SELECT match_id, 0.4+2*p_h lh, 0.3+2*p_a la FROM preds), g AS (SELECT CAST(i AS INT) k FROM range(11) t(i)), f AS (SELECT k, {_FACT} fa FROM g), c AS (SELECT match_id, h.k h, a.k a, round(exp(-lh)*pow(lh,h.k)/h.fa*exp(-la)*pow(la,a.k)/a.fa,12) p FROM r, f h, f a), o AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY p DESC, h, a) rn FROM c)"


@query(_GRID3 + " SELECT match_id, string_agg(h || '-' || a, ',' ORDER BY rn) AS top FROM o WHERE rn<=3 GROUP BY 1")
def likeliest_scores(spark, d):
    r = _preds(spark, d).select("match_id", (0.4 + 2 * F.col("p_h")).alias("lh"), (0.3 + 2 * F.col("p_a")).alias("la"))
    return models.top_scores(r, "match_id", "lh", "la")


_BOOK = ", q AS (SELECT *, CASE result WHEN 'H' THEN p_h WHEN 'D' THEN p_d ELSE p_a END m, CASE result WHEN 'H' THEN 1/odds_h WHEN 'D' THEN 1/odds_d ELSE 1/odds_a END/(1/odds_h+1/odds_d+1/odds_a) b FROM preds)"


@query(_BOOK + ", w AS (SELECT CAST(i AS INT) i FROM range(11) t(i)), g AS (SELECT i, round(avg(-ln(greatest(m*(i/10.0e0)+b*((10-i)/10.0e0)+(1/3.0e0)*0,1e-12))),9) log_loss FROM q, w GROUP BY 1) SELECT round(i/10.0e0,9) w_m, round((10-i)/10.0e0,9) w_b, log_loss, row_number() OVER (ORDER BY log_loss, i)=1 best FROM g")
def ensemble_weights(spark, d):
    book = {x: 1 / F.col(f"odds_{x}") for x in "hda"}
    p = _preds(spark, d).withColumn("m", ev.p_of_result()).withColumn("b", F.when(F.col("result") == "H", book["h"]).when(F.col("result") == "D", book["d"]).otherwise(book["a"]) / sum(book.values(), F.lit(0.0)))
    return dec.ensemble_weights(p, ["m", "b"]).select(*r9("w_m", "w_b"), "log_loss", "best")


@query(", w(t) AS (VALUES (0.5e0),(0.75e0),(1.0e0),(1.25e0),(1.5e0),(2.0e0),(3.0e0)), g AS (SELECT t, round(avg(-ln(CASE result WHEN 'H' THEN pow(p_h,1/t) WHEN 'D' THEN pow(p_d,1/t) ELSE pow(p_a,1/t) END/(pow(p_h,1/t)+pow(p_d,1/t)+pow(p_a,1/t)))),9) log_loss FROM preds, w GROUP BY 1) SELECT t temperature, log_loss, row_number() OVER (ORDER BY log_loss, t)=1 best FROM g")
def temperature_grid(spark, d):
    return dec.temperature_grid(_preds(spark, d))


@query(", x AS (SELECT *, CASE WHEN match_id%4<>0 THEN p_h+0.1e0 END z FROM preds) SELECT match_id, " + s9(mean="(0.5e0*p_h+coalesce(0.3e0*z,0)+0.2e0*p_a)/(0.5e0+CASE WHEN z IS NULL THEN 0 ELSE 0.3e0 END+0.2e0)") + " FROM x")
def weighted_fields(spark, d):
    z = F.when(F.col("match_id") % 4 != 0, F.col("p_h") + 0.1)
    made = dec.weighted_mean([(0.5, {"mean": F.col("p_h")}), (0.3, {"mean": z}), (0.2, {"mean": F.col("p_a")})], ("mean",))
    return _preds(spark, d).select("match_id", F.round(made["mean"], 9).alias("mean"))


@query(", x AS (SELECT match_id, p_h, p_d, p_a, p_d+0.05e0 m, (league%3)*0.04e0+0.2e0 r FROM preds), o AS (SELECT *, ((m>CASE WHEN r>0.28e0 THEN 0.22e0 WHEN r>=0.22e0 THEN 0.26e0 ELSE 0.30e0 END AND abs(p_h-p_a)<0.25e0) OR m>0.40e0) ov FROM x), u AS (SELECT *, CASE WHEN ov THEN least(0.42e0, greatest(p_d,m)+greatest(0,0.32e0-p_d)*0.4e0) ELSE p_d END d FROM o) SELECT match_id, ov draw_override, " + s9(p_h="p_h/CASE WHEN ov THEN p_h+d+p_a ELSE 1 END", p_d="d/CASE WHEN ov THEN p_h+d+p_a ELSE 1 END", p_a="p_a/CASE WHEN ov THEN p_h+d+p_a ELSE 1 END") + " FROM u")
def draw_override(spark, d):
    made = dec.draw_override(_preds(spark, d), F.col("p_d") + 0.05, (F.col("league") % 3) * 0.04 + 0.2)
    return made.select("match_id", "draw_override", *r9("p_h", "p_d", "p_a"))


@query(""", t AS (SELECT match_id, 0 place, '1x2' market, '1' pick, p_h p FROM preds UNION ALL SELECT match_id, 1, '1x2', '2', p_a FROM preds UNION ALL SELECT match_id, 2, 'double_chance', '1X', p_h+p_d FROM preds UNION ALL SELECT match_id, 3, 'double_chance', 'X2', p_d+p_a FROM preds UNION ALL SELECT match_id, 4, 'over15', 'over', p_h+0.3e0 FROM preds UNION ALL SELECT match_id, 5, 'over15', 'under', 1-p_h-0.3e0 FROM preds),
 g AS (SELECT *, row_number() OVER (PARTITION BY match_id, market ORDER BY place) k FROM t WHERE p>=0.7e0), o AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(p*100,1) DESC, place) rank FROM g WHERE k=1) SELECT match_id, CAST(rank AS INT) AS rank, market, pick, round(p*100,1) confidence FROM o WHERE rank<=12""")
def recommendations(spark, d):
    tips = [("1x2", "1", F.col("p_h")), ("1x2", "2", F.col("p_a")), ("double_chance", "1X", F.col("p_h") + F.col("p_d")), ("double_chance", "X2", F.col("p_d") + F.col("p_a")), ("over15", "over", F.col("p_h") + 0.3), ("over15", "under", 1 - F.col("p_h") - 0.3)]
    return dec.recommendations(_preds(spark, d), "match_id", tips)


@query(f", n AS (SELECT league, count(*) c FROM matches GROUP BY 1) SELECT match_id, round(greatest(p_h,p_d,p_a),9) confidence, round(greatest(p_h,p_d,p_a)-least(p_h,p_d,p_a),9) spread, greatest(p_h,p_d,p_a)>=0.6 AND c>=1000 playable, CASE {_PICK} WHEN 'H' THEN '1' WHEN 'D' THEN 'X' ELSE '2' END || ' ' || CAST(round(greatest(p_h,p_d,p_a)*100) AS INT) || '%' line FROM preds p JOIN n ON n.league=p.league")
def prediction_payload(spark, d):
    p = _preds(spark, d)
    made = dec.payload(p.join(p.groupBy("league").agg(F.count("*").alias("c")), "league"), F.col("c"))
    return made.select("match_id", *r9("confidence", "spread"), "playable", dec.summary_line(made).alias("line"))


@query(f", g AS (SELECT avg(CAST(result='H' AS INT)) h, avg(CAST(result='D' AS INT)) dd, avg(CAST(result='A' AS INT)) a FROM preds), o AS (SELECT league, avg(CAST(result='H' AS INT)) h, avg(CAST(result='D' AS INT)) dd, avg(CAST(result='A' AS INT)) a FROM preds GROUP BY 1), s AS (SELECT p.league, count(*) n, avg(-ln({_PR})) m, avg(-ln(CASE result WHEN 'H' THEN g.h WHEN 'D' THEN g.dd ELSE g.a END)) gl, avg(-ln(CASE result WHEN 'H' THEN o.h WHEN 'D' THEN o.dd ELSE o.a END)) ol FROM preds p JOIN o ON o.league=p.league CROSS JOIN g GROUP BY 1) SELECT league, n, round(m,9) model_ll, round(gl,9) global_ll, round(ol,9) league_ll, gl-ol>0.01 own_model FROM s")
def league_benchmark(spark, d):
    return dec.league_benchmark(_preds(spark, d)).select("league", "n", *r9("model_ll", "global_ll", "league_ll"), "own_model")


_TR = _RECS + ", tr AS (SELECT *, home_team_id team, 1 is_home, 1-correct wrong FROM recs UNION ALL SELECT *, away_team_id, 0, 1-correct FROM recs)"


@query(_TR + """, o AS (SELECT team, wrong, row_number() OVER (PARTITION BY team ORDER BY date, match_id) f, row_number() OVER (PARTITION BY team ORDER BY date DESC, match_id DESC) b, avg(wrong) OVER (PARTITION BY team ORDER BY date, match_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) r, count(*) OVER (PARTITION BY team) n FROM tr)
 SELECT team, max(n) n, round(avg(CASE WHEN b<=10 THEN wrong END),9) recent, round(CASE WHEN max(n)>=10 THEN avg(CASE WHEN b<=10 THEN wrong END)-CASE WHEN max(n)>=20 THEN avg(CASE WHEN b BETWEEN 11 AND 20 THEN wrong END) ELSE avg(CASE WHEN f<=10 THEN wrong END) END ELSE 0 END,9) trend, round(CASE WHEN max(n)>=10 THEN stddev_pop(CASE WHEN f>=10 THEN r END) ELSE 0 END,9) volatility FROM o GROUP BY 1""")
def error_trends(spark, d):
    return dec.error_trends(_recs(spark, d)).select("team", "n", *r9("recent", "trend", "volatility"))


@query(_TR + """ SELECT team, count(*) n, """ + s9(error_rate="avg(wrong)", avg_margin="avg(error_margin)", log_loss="avg(loss)", home_error_rate="coalesce(avg(CASE WHEN result='H' THEN wrong END),0.5)", draw_error_rate="coalesce(avg(CASE WHEN result='D' THEN wrong END),0.5)", away_error_rate="coalesce(avg(CASE WHEN result='A' THEN wrong END),0.5)", home_performance="coalesce(1-avg(CASE WHEN is_home=1 THEN wrong END),0.5)", away_performance="coalesce(1-avg(CASE WHEN is_home=0 THEN wrong END),0.5)",
       goal_error="avg(abs(CASE WHEN home_goals+away_goals=0 THEN p_d WHEN home_goals+away_goals=1 THEN CASE WHEN home_goals=1 THEN p_h ELSE p_a END ELSE (p_h+p_a)/2 END-0.5))", calibration_gap="abs(avg(confidence)-(1-avg(wrong)))") + " FROM tr GROUP BY 1")
def error_features(spark, d):
    return dec.error_features(_recs(spark, d)).select("team", "n", *r9("error_rate", "avg_margin", "log_loss", "home_error_rate", "draw_error_rate", "away_error_rate", "home_performance", "away_performance", "goal_error", "calibration_gap"))


@query(_RECS + " SELECT league, count(*) n, " + s9(error_rate="1-avg(correct)", avg_margin="avg(error_margin)", log_loss="avg(loss)", home_bias="avg(CAST(predicted='H' AS INT))-avg(CAST(result='H' AS INT))", draw_bias="avg(CAST(predicted='D' AS INT))-avg(CAST(result='D' AS INT))", away_bias="avg(CAST(predicted='A' AS INT))-avg(CAST(result='A' AS INT))") + " FROM recs GROUP BY 1")
def league_error_features(spark, d):
    return dec.league_error_features(_recs(spark, d)).select("league", "n", *r9("error_rate", "avg_margin", "log_loss", "home_bias", "draw_bias", "away_bias"))


@query(_TR + """, e AS (SELECT team, avg(wrong) e FROM tr GROUP BY 1), x AS (SELECT r.match_id, r.p_h, r.p_d, r.p_a, greatest(p_h,p_d,p_a) t, 1-(coalesce(h.e,0.5)+coalesce(a.e,0.5))/2 f FROM recs r LEFT JOIN e h ON h.team=home_team_id LEFT JOIN e a ON a.team=away_team_id), c AS (SELECT *, CASE WHEN f<0.6 AND t>0.7 THEN (t-0.7e0)*0.3e0 ELSE 0 END k, CAST(p_h<>t AS INT)+CAST(p_d<>t AS INT)+CAST(p_a<>t AS INT) o FROM x),
 n AS (SELECT match_id, f, CASE WHEN p_h=t THEN p_h-k ELSE p_h+k/o END h, CASE WHEN p_d=t THEN p_d-k ELSE p_d+k/o END d, CASE WHEN p_a=t THEN p_a-k ELSE p_a+k/o END a FROM c) SELECT match_id, """ + s9(confidence_factor="f", p_h="h/(h+d+a)", p_d="d/(h+d+a)", p_a="a/(h+d+a)") + " FROM n")
def confidence_shrink(spark, d):
    recs = _recs(spark, d)
    return dec.shrunk(recs, dec.error_features(recs)).select("match_id", *r9("confidence_factor", "p_h", "p_d", "p_a"))


@query(_TR + """, b AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date DESC, match_id DESC) k FROM tr), l AS (SELECT *, count(*) OVER (PARTITION BY team) c FROM b WHERE k<=10), w AS (SELECT *, exp(-CASE WHEN c>1 THEN (k-1.0e0)/(c-1) ELSE 1 END) wt FROM l)
 SELECT team, """ + ", ".join(f"round(greatest(-0.2e0,least(0.2e0,sum(wt*(CAST(result='{x.upper()}' AS INT)-p_{x}))/sum(wt))),9) bias_{x}" for x in "hda") + " FROM w GROUP BY 1")
def bias_profiles(spark, d):
    return dec.bias_profiles(_recs(spark, d)).select("team", *r9("bias_h", "bias_d", "bias_a"))


@query(_RECS + """, hh AS (SELECT home_team_id t, count(*) n, avg(CAST(result='H' AS INT)) h, avg(CAST(result='D' AS INT)) dd FROM recs GROUP BY 1), aa AS (SELECT away_team_id t, count(*) n, avg(CAST(result='A' AS INT)) a, avg(CAST(result='D' AS INT)) dd FROM recs GROUP BY 1),
 x AS (SELECT match_id, p_h, p_d, p_a, CASE WHEN hh.n>=5 AND hh.h<0.3 AND p_h>0.45 THEN least((p_h-hh.h)*0.3,0.05) ELSE 0 END wh, CASE WHEN aa.n>=5 AND aa.a<0.2 AND p_a>0.4 THEN least((p_a-aa.a)*0.3,0.05) ELSE 0 END wa, CASE WHEN hh.n>=5 AND hh.dd>0.4 AND p_d<0.25 THEN least((hh.dd-p_d)*0.3,0.05) ELSE 0 END+CASE WHEN aa.n>=5 AND aa.dd>0.4 AND p_d<0.25 THEN least((aa.dd-p_d)*0.3,0.05) ELSE 0 END dr FROM recs LEFT JOIN hh ON hh.t=home_team_id LEFT JOIN aa ON aa.t=away_team_id),
 y AS (SELECT match_id, p_h-wh+wa/2-dr/2 h, p_d+wh/2+wa/2+dr d, p_a+wh/2-wa-dr/2 a FROM x) SELECT match_id, """ + s9(p_h="h/(h+d+a)", p_d="d/(h+d+a)", p_a="a/(h+d+a)") + " FROM y")
def team_corrections(spark, d):
    recs = _recs(spark, d)
    return dec.team_corrected(recs, recs).select("match_id", *r9("p_h", "p_d", "p_a"))


# reports


@query(f", s AS (SELECT count(*) n, avg(-ln({_PR})) ll, avg({_BR}) b, avg({_HIT}) acc, avg(CAST(result='H' AS INT)) h, avg(CAST(result='D' AS INT)) dd, avg(CAST(result='A' AS INT)) a FROM preds) SELECT n, " + s9(log_loss="ll", naive_log_loss="-(h*ln(h)+dd*ln(dd)+a*ln(a))", brier="b", accuracy="acc", majority="greatest(h,dd,a)") + " FROM s")
def naive_baselines(spark, d):
    return rp.naive_baselines(_preds(spark, d)).select("n", *r9("log_loss", "naive_log_loss", "brier", "accuracy", "majority"))


@query(f"SELECT {_PICK} pick, count(*) n, " + s9(hit_rate=f"avg({_HIT})", confidence="avg(greatest(p_h,p_d,p_a))") + " FROM preds GROUP BY 1")
def hits_by_pick(spark, d):
    return rp.hits_by_pick(_preds(spark, d)).select("pick", "n", *r9("hit_rate", "confidence"))


@query(f", x AS (SELECT CAST(floor((greatest(p_h,p_d,p_a)-0.35)/0.05+1e-9) AS INT) k, {_HIT} h, greatest(p_h,p_d,p_a) t FROM preds WHERE greatest(p_h,p_d,p_a)>=0.35 AND greatest(p_h,p_d,p_a)<0.75) SELECT round(0.35e0+k*0.05e0,2) from_p, count(*) n, " + s9(hit_rate="avg(h)", confidence="avg(t)") + " FROM x GROUP BY k HAVING count(*)>10")
def confidence_buckets(spark, d):
    return rp.confidence_buckets(_preds(spark, d)).select("from_p", "n", *r9("hit_rate", "confidence"))


@query(f", t(edge) AS (VALUES (0.0e0),(0.03e0),(0.05e0),(0.08e0),(0.10e0),(0.15e0)), x AS (SELECT greatest(p_h*odds_h,p_d*odds_d,p_a*odds_a)-1 e, {_PICK}=result w, CASE {_PICK} WHEN 'H' THEN odds_h WHEN 'D' THEN odds_d ELSE odds_a END o FROM preds WHERE odds_h>1.01 AND odds_d>1.01 AND odds_a>1.01) SELECT edge, count(*) bets, " + s9(profit="sum(CASE WHEN w THEN o-1 ELSE -1 END)", roi="sum(CASE WHEN w THEN o-1 ELSE -1 END)/count(*)", hit_rate="avg(CAST(w AS INT))") + " FROM t JOIN x ON e>edge GROUP BY 1 HAVING count(*)>=5")
def flat_stakes(spark, d):
    return rp.flat_stakes(_preds(spark, d)).select("edge", "bets", *r9("profit", "roi", "hit_rate"))


@query(", x AS (SELECT 'btts' market, p_d+0.3e0 p, home_goals>0 AND away_goals>0 y FROM preds UNION ALL SELECT 'over25', p_h+0.1e0, home_goals+away_goals>2 FROM preds) SELECT market, " + s9(log_loss="avg(-(CAST(y AS INT)*ln(greatest(least(p,1-1e-9),1e-9))+(1-CAST(y AS INT))*ln(1-greatest(least(p,1-1e-9),1e-9))))", brier="avg((p-CAST(y AS INT))*(p-CAST(y AS INT)))", accuracy="avg(CAST((p>0.5)=y AS INT))", majority="greatest(avg(CAST(y AS INT)),1-avg(CAST(y AS INT)))") + " FROM x GROUP BY 1")
def binary_markets(spark, d):
    h, a = F.col("home_goals"), F.col("away_goals")
    made = rp.majority_baseline(_preds(spark, d), {"btts": (F.col("p_d") + 0.3, (h > 0) & (a > 0)), "over25": (F.col("p_h") + 0.1, h + a > 2)})
    return made.select("market", *r9("log_loss", "brier", "accuracy", "majority"))


_FOLDS = """, o AS (SELECT *, CAST(floor(((year(date)-1996)*12+month(date)-1)/3.0) AS INT) own FROM preds), fo AS (SELECT CAST(i AS INT) fold FROM range(4) t(i)), e AS (SELECT fold, o.* FROM o JOIN fo ON own<=fold), z AS (SELECT fold, sum(CAST(own=fold AS INT)) v, sum(CAST(own<fold AS INT)) tr FROM e GROUP BY 1),
 k AS (SELECT e.*, z.tr, row_number() OVER (PARTITION BY e.fold, e.own<e.fold ORDER BY date DESC, match_id DESC) rn FROM e JOIN z ON z.fold=e.fold WHERE v>=50), parts AS (SELECT *, CASE WHEN own=fold THEN 'validate' WHEN rn<=greatest(50,floor(tr*0.15e0)) THEN 'calibrate' ELSE 'train' END part FROM k)"""


@query(_FOLDS + " SELECT fold, part, count(*) n, min(date) first, max(date) last FROM parts GROUP BY 1,2")
def fold_parts(spark, d):
    made = rp.walk_forward(_preds(spark, d), "1996-01-01")
    return made.groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


_FS = _FOLDS + f""", r AS (SELECT fold, avg(CAST(result='H' AS INT)) h, avg(CAST(result='D' AS INT)) dd, avg(CAST(result='A' AS INT)) a FROM parts WHERE part<>'validate' GROUP BY 1), v1 AS (SELECT fold, result, p_h, p_d, p_a, 'given' model FROM parts WHERE part='validate' UNION ALL SELECT p.fold, result, h, dd, a, 'rates' FROM parts p JOIN r ON r.fold=p.fold WHERE part='validate'),
 fs AS (SELECT model, fold, count(*) n, avg(-ln({_PR})) log_loss, avg({_BR}) brier, avg({_HIT}) accuracy FROM v1 GROUP BY 1,2)"""


@query(_FS + " SELECT model, fold, n, " + s9(log_loss="log_loss", brier="brier", accuracy="accuracy") + " FROM fs")
def fold_scores(spark, d):
    return rp.fold_scores(rp.walk_forward(_preds(spark, d), "1996-01-01")).select("model", "fold", "n", *r9("log_loss", "brier", "accuracy"))


@query(_FS + " SELECT model, CAST(sum(n) AS BIGINT) n, " + s9(log_loss="avg(log_loss)", brier="avg(brier)", accuracy="avg(accuracy)") + " FROM fs GROUP BY 1")
def fold_summary(spark, d):
    return rp.fold_summary(rp.fold_scores(rp.walk_forward(_preds(spark, d), "1996-01-01"))).select("model", "n", *r9("log_loss", "brier", "accuracy"))


_SELF = "CASE WHEN greatest(p_h*odds_h-1,p_d*odds_d-1,p_a*odds_a-1)<0.03 THEN -1 WHEN p_h*odds_h-1=greatest(p_h*odds_h-1,p_d*odds_d-1,p_a*odds_a-1) THEN 0 WHEN p_d*odds_d-1=greatest(p_h*odds_h-1,p_d*odds_d-1,p_a*odds_a-1) THEN 1 ELSE 2 END"


@query(_FOLDS + f", b AS (SELECT fold, {_SELF} s, odds_h, odds_d, odds_a, result FROM parts WHERE part='validate'), w AS (SELECT fold, CASE s WHEN 0 THEN odds_h WHEN 1 THEN odds_d ELSE odds_a END o, CASE s WHEN 0 THEN 'H' WHEN 1 THEN 'D' ELSE 'A' END=result won FROM b WHERE s>=0) SELECT fold, count(*) bets, CAST(sum(CAST(won AS INT)) AS BIGINT) hits, round(sum(CASE WHEN won THEN o-1 ELSE -1.0 END)/count(*),6) net_roi, round(sum(CASE WHEN won THEN o-1 ELSE 0 END)/count(*),6) published_roi FROM w GROUP BY 1")
def betting_folds(spark, d):
    return rp.betting_folds(rp.walk_forward(_preds(spark, d), "1996-01-01"))


@query(f"SELECT league, count(*) n, " + s9(accuracy=f"avg({_HIT})", p_right=f"avg(CASE WHEN {_PICK}=result THEN greatest(p_h,p_d,p_a) END)", p_wrong=f"avg(CASE WHEN {_PICK}<>result THEN greatest(p_h,p_d,p_a) END)") + f", CAST(sum(CAST(greatest(p_h,p_d,p_a)>=0.6 AS INT)) AS BIGINT) sure, CAST(sum(CAST(greatest(p_h,p_d,p_a)>=0.6 AND {_PICK}=result AS INT)) AS BIGINT) sure_right FROM preds GROUP BY 1")
def pick_report(spark, d):
    return rp.pick_report(_preds(spark, d)).select("league", "n", *r9("accuracy", "p_right", "p_wrong"), "sure", "sure_right")


@query("SELECT r_name AS name, count(*) n, count(DISTINCT home_team_id) teams, " + s9(goals="avg(home_goals+away_goals)", home_rate="avg(CAST(home_goals>away_goals AS INT))", draw_rate="avg(CAST(home_goals=away_goals AS INT))") + ", max(date) last FROM matches JOIN region ON r_regionkey=league GROUP BY 1")
def league_overview(spark, d):
    names = table(spark, d, "region").select(F.col("r_regionkey").alias("league"), F.col("r_name").alias("name"))
    return rp.league_overview(matches(spark, d), names).select("name", "n", "teams", *r9("goals", "home_rate", "draw_rate"), "last")


@query(", s(label) AS (VALUES ('T-24H'),('KO'),('LIVE45')) SELECT match_id || '_' || label prediction_id, result, " + s9(log_loss=f"-ln({_PR})", brier=_BR) + " FROM preds, s")
def settled_predictions(spark, d):
    p = _preds(spark, d)
    stored = p.select("match_id", "p_h", "p_d", "p_a", F.explode(F.array(F.lit("T-24H"), F.lit("KO"), F.lit("LIVE45"))).alias("label")).withColumn("prediction_id", F.concat_ws("_", F.col("match_id").cast("string"), "label"))
    return rp.settled(stored, p.select("match_id", "result")).select("prediction_id", "result", *r9("log_loss", "brier"))


@query(""", l AS (SELECT match_id id, home_team_id home, away_team_id away, date "at", CASE WHEN match_id%2=0 THEN date END match_date FROM matches WHERE season>=1998), m AS (SELECT least(home_team_id,away_team_id) lo, greatest(home_team_id,away_team_id) hi, max(date) last FROM matches GROUP BY 1,2), f AS (SELECT id, home, away, "at", coalesce(match_date,last) match_date FROM l LEFT JOIN m ON lo=least(home,away) AND hi=greatest(home,away)),
 n AS (SELECT *, row_number() OVER (PARTITION BY home, away ORDER BY "at" DESC, id DESC) rn FROM f) SELECT id, home, away, match_date FROM n WHERE rn=1 ORDER BY "at" DESC, id DESC LIMIT 200""")
def prediction_log(spark, d):
    m = matches(spark, d)
    log = m.where("season >= 1998").select(F.col("match_id").alias("id"), F.col("home_team_id").alias("home"), F.col("away_team_id").alias("away"), F.col("date").alias("at"), F.when(F.col("match_id") % 2 == 0, F.col("date")).alias("match_date"))
    return rp.prediction_log(log, m).select("id", "home", "away", "match_date")


@query(", r AS (SELECT match_id, m AS mi, 0.4e0+2*p_h h, 0.3e0+2*p_a a, home_goals*m/90.0e0 xh, away_goals*m/90.0e0 xa FROM preds, (VALUES (10),(45),(90)) t(m)) SELECT match_id, mi AS \"minute\", " + s9(lh="xh+h*greatest(0,(90-mi)/90.0e0)", la="xa+a*greatest(0,(90-mi)/90.0e0)") + " FROM r")
def replay_snapshots(spark, d):
    from touchline.operators.live import live_rates

    p = _preds(spark, d).withColumn("minute", F.explode(F.array(F.lit(10), F.lit(45), F.lit(90))))
    lh, la = live_rates(F.col("minute"), 0.4 + 2 * F.col("p_h"), 0.3 + 2 * F.col("p_a"), F.col("home_goals") * F.col("minute") / 90, F.col("away_goals") * F.col("minute") / 90)
    return p.select("match_id", "minute", F.round(lh, 9).alias("lh"), F.round(la, 9).alias("la"))


# matching


@query(", e AS (SELECT c_custkey id, lower(trim(c_mktsegment)) || ' ' || (c_custkey%40) AS key, CASE WHEN c_custkey%2=0 THEN upper(c_mktsegment) ELSE c_mktsegment END || '  ' || (c_custkey%40) AS name, c_nationkey country, c_custkey%17 n, c_acctbal r FROM customer) SELECT key, country, arg_max(id, (n, -id)) id, arg_max(name, (n, -id)) AS name, CAST(sum(n) AS BIGINT) matches, max(r) rating FROM e GROUP BY 1,2")
def merged_entities(spark, d):
    seg = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(seg, F.lit("  "), (F.col("c_custkey") % 40).cast("string")).alias("name"), F.col("c_nationkey").alias("country"), (F.col("c_custkey") % 17).alias("matches"), F.col("c_acctbal").alias("rating"))
    return mt.merged_entities(e)


@query(", a AS (SELECT c_custkey id, c_name AS name FROM customer WHERE c_custkey%3=0), b AS (SELECT c_custkey id, 'B ' || c_name AS name FROM customer WHERE c_custkey%2=0) SELECT c.c_custkey id, coalesce(a.name, b.name, 'Team ' || c.c_custkey) AS name FROM customer c LEFT JOIN a ON a.id=c.c_custkey LEFT JOIN b ON b.id=c.c_custkey")
def resolved_names(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return mt.resolved_names(c.select("id"), c.where("id % 3 = 0"), c.where("id % 2 = 0").withColumn("name", F.concat(F.lit("B "), "name")))


@query(" SELECT match_id, CASE WHEN match_id%2=0 THEN home_corners ELSE CAST(round_even(home_goals*0.5e0,0) AS INT) END home_sot, CASE WHEN match_id%2=0 THEN away_corners WHEN match_id%5<>0 THEN CAST(round_even(away_goals*0.5e0,0) AS INT) END away_sot FROM matches")
def shots_filled(spark, d):
    m = matches(spark, d)
    side = F.explode(F.array(F.struct(F.lit(1).alias("is_home"), (F.col("home_goals") * 0.5).alias("xg")), F.struct(F.lit(0).alias("is_home"), F.when(F.col("match_id") % 5 != 0, F.col("away_goals") * 0.5).alias("xg"))))
    even = F.col("match_id") % 2 == 0
    own = m.select("match_id", F.when(even, F.col("home_corners")).alias("home_sot"), F.when(even, F.col("away_corners")).alias("away_sot"))
    return mt.sides_filled(own, m.select("match_id", side.alias("s")).select("match_id", "s.*"))


_SIM = """CASE WHEN a='' OR b='' THEN 0 WHEN a=b THEN 1 WHEN (contains(b,a) AND length(a)>5) OR (contains(a,b) AND length(b)>5) THEN 0.95 WHEN len(list_intersect(x,y))>0 AND len(list_intersect(x,y))>=least(2,least(len(x),len(y))) THEN 0.85e0+0.10e0*len(list_intersect(x,y))/greatest(len(x),len(y)) ELSE least(0.80,1-levenshtein(a,b)/CAST(greatest(length(a),length(b)) AS DOUBLE)) END"""


@query(f""", k AS (SELECT p_partkey%500 id, min(lower(trim(p_name))) b FROM part GROUP BY 1), q AS (SELECT id+100000 qid, CASE id%3 WHEN 0 THEN b WHEN 1 THEN b || ' fc' ELSE split_part(b,' ',2) || ' ' || split_part(b,' ',1) END a FROM k), w AS (SELECT *, list_distinct(list_filter(string_split(a,' '), lambda z: length(z)>3)) x, list_distinct(list_filter(string_split(b,' '), lambda z: length(z)>3)) y FROM q, k), s AS (SELECT qid, id, {_SIM} s FROM w)
 SELECT qid query_id, arg_max(id, (s, -id)) team_id, round(max(s),9) score FROM s WHERE s>=0.85 GROUP BY 1""")
def name_matches(spark, d):
    k = table(spark, d, "part").groupBy((F.col("p_partkey") % 500).alias("team_id")).agg(F.min(F.lower(F.trim("p_name"))).alias("name"))
    part = lambda i: F.split_part("name", F.lit(" "), F.lit(i))
    asked = F.when(F.col("team_id") % 3 == 0, F.col("name")).when(F.col("team_id") % 3 == 1, F.concat("name", F.lit(" fc"))).otherwise(F.concat_ws(" ", part(2), part(1)))
    q = k.select((F.col("team_id") + 100_000).alias("query_id"), asked.alias("name"))
    return mt.match_names(q, k).select("query_id", "team_id", *r9("score"))


@query(f"SELECT {_PICK} predicted, result actual, count(*) n FROM (SELECT result, p_h, p_d, p_a FROM preds) GROUP BY 1,2".replace(_PICK, "CASE WHEN p_h>=p_d THEN 'H' WHEN p_a>=p_h THEN 'A' WHEN p_a>=p_d THEN 'D' ELSE 'H' END"))
def confusion_published(spark, d):
    return _preds(spark, d).groupBy(ev.picked("reference").alias("predicted"), F.col("result").alias("actual")).agg(F.count("*").alias("n"))


@query(", x AS (SELECT CAST(result='H' AS INT) y, floor(p_h*10)/10 p FROM preds), b AS (SELECT y, p, least(CAST(floor(p*10) AS INT),9) k FROM x UNION ALL SELECT y, p, CAST(floor(p*10) AS INT)-1 FROM x WHERE floor(p*10)=p*10 AND p>0 AND least(floor(p*10),9)=p*10), g AS (SELECT k, count(*) n, avg(p) mp, avg(y) my FROM b GROUP BY 1) SELECT round(sum(n*abs(mp-my))/(SELECT count(*) FROM x),6) ece FROM g")
def calibration_published(spark, d):
    p = _preds(spark, d).select((F.col("result") == "H").cast("int").alias("y"), (F.floor(F.col("p_h") * 10) / 10).alias("p"))
    return ev.calibration_error(p, "y", "p", compat=True)


@query()
def elo_variants(spark, d):
    """Draws at a half, slower moves, the edge turned round with whole numbers, and the edge with the winner."""
    m = matches(spark, d)
    rules = {"half_draw": models.Elo(draw=0.5), "slow": models.Elo(k=20.0, draw=0.5), "reversed": models.Elo(edge=-50.0, draw=0.5, digits=0), "winner": models.Elo(winner_edge=True, draw=0.5)}
    return models.elo_by_rules(m, rules).select("rule", "match_id", *r9("home_elo", "away_elo"))


@query()
def elo_incremental(spark, d):
    """Ratings of matches from 1998 on, from the snapshot after 1997: the same as those of the whole chain."""
    m = matches(spark, d)
    made = models.elo_ratings(m.where("season >= 1998"), seeds=models.elo_state(m.where("season < 1998")))
    return made.select("match_id", *r9("home_elo", "away_elo", "home_att", "away_def"))


@query()
def elo_1x2_fitted(spark, d):
    m = matches(spark, d)
    return models.elo_1x2(models.elo_ratings(m), models.fitted_draw_rate(m)).select("match_id", *r9("p_h", "p_d", "p_a"))


@query()
def global_dixon_coles(spark, d):
    from touchline.operators import estimation

    return estimation.global_strengths(matches(spark, d), top=60).select("team", *r9("attack", "defence", "base", "home", "rho"), "n")


@query()
def correction_plans(spark, d):
    """Actions for groups that err more than their share; planted, as the tables hold few such groups."""
    recs = _recs(spark, d).withColumn("correct", F.when(F.col("league") == 1, F.lit(0)).otherwise(F.col("correct")))
    return dec.correction_plan(fb.patterns(recs))
