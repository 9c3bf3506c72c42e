"""Feature projections over matches with form, rating and market columns; all are column expressions and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.operators.ordering import row_numbers
from touchline.functions import elo_expected

#: Matches from which on a league counts as fully known.
KNOWN_LEAGUE = 3000


def _or(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


def interactions(df: DataFrame) -> DataFrame:
    """Differences, powers, rates and flags of both sides' last-five form (gf_5, ga_5, pts_5) and ratings (elo, attack_elo, defence_elo)."""
    d = {c: _or(f"home_{c}_5") - _or(f"away_{c}_5") for c in ("pts", "gf", "ga")}
    attack = {s: _or(f"{s}_gf_5") * _or(f"{s}_attack_elo", 1500) / 1500 for s in ("home", "away")}
    defence = {s: _or(f"{s}_ga_5") * _or(f"{s}_defence_elo", 1500) / 1500 for s in ("home", "away")}
    rate = {s: _or(f"{s}_gf_5") / (_or(f"{s}_ga_5", 1) + 0.1) for s in ("home", "away")}
    elo = _or("home_elo", 1500) - _or("away_elo", 1500)
    goals, flag = _or("home_gf_5") + _or("away_gf_5"), lambda c: c.cast("int")
    total_a, total_d = attack["home"] + attack["away"], defence["home"] + defence["away"]
    return df.withColumns({
        "elo_diff": elo, "elo_diff_abs": F.abs(elo), "form_diff": d["pts"], "form_diff_abs": F.abs(d["pts"]), "gf_diff": d["gf"], "gf_diff_abs": F.abs(d["gf"]),
        "ga_diff": d["ga"], "ga_diff_abs": F.abs(d["ga"]), "home_attack_power": attack["home"], "away_attack_power": attack["away"], "home_defence_power": defence["home"], "away_defence_power": defence["away"],
        "total_attack": total_a, "total_defence": total_d, "attack_defence_ratio": total_a / (total_d + 0.1), "home_scoring_rate": rate["home"], "away_scoring_rate": rate["away"], "scoring_rate_diff": rate["home"] - rate["away"],
        "both_attack_strong": flag((_or("home_gf_5") > 1.0) & (_or("away_gf_5") > 1.0)), "both_defence_weak": flag((_or("home_ga_5") > 1.2) & (_or("away_ga_5") > 1.2)),
        "high_scoring": flag(goals > 2.5), "low_scoring": flag(goals < 1.5), "teams_even": flag(F.abs(elo) < 30), "very_even": flag(F.abs(elo) < 15),
    })


def enhanced(df: DataFrame) -> DataFrame:
    """Fifteen features: market misalignment, form ratios, both-score signal, overall strength, and trust in the league.

    Points per game divide a mean by five once more, as published."""
    eh = elo_expected(F.col("home_elo"), F.col("away_elo"))
    ratio = lambda s: F.coalesce(F.col(f"{s}_gf_5") / (F.col(f"{s}_ga_5") + 0.5), F.lit(1.0))
    attack = lambda s: F.coalesce(F.col(f"{s}_gf_5") / (F.col(f"{s}_gf_5") + F.col(f"{s}_ga_5") + 0.1), F.lit(1.0))
    pts = {s: F.col(f"{s}_pts_5") / 5.0 for s in ("home", "away")}
    whole = {s: F.col(f"{s}_elo") + F.col(f"{s}_attack_elo") / 10.0 + pts[s] * 50.0 for s in ("home", "away")}
    sizes = df.groupBy("league").agg(F.greatest(F.least(F.count("*") / KNOWN_LEAGUE, F.lit(1.0)), F.lit(0.2)).alias("lg_confidence_weight"))
    made = df.withColumns({
        "mkt_home_misalign": F.coalesce(eh - F.col("mkt_home_prob"), F.lit(0.0)),
        "mkt_draw_mismatch": F.coalesce(F.col("mkt_draw_prob") - (1 - F.abs(2 * eh - 1) * 0.8), F.lit(0.0)),
        "mkt_over_misalign": F.coalesce(F.col("lg_over25_rate") - F.col("mkt_over25_prob"), F.lit(0.0)),
        "home_gf_per_ga": ratio("home"), "away_gf_per_ga": ratio("away"), "home_attack_ratio": attack("home"), "away_attack_ratio": attack("away"),
        "home_pts_per_game": pts["home"], "away_pts_per_game": pts["away"], "form_pts_diff": pts["home"] - pts["away"],
        "btts_signal": F.coalesce(F.col("h2h_btts"), F.col("lg_btts_rate")) * 0.5 + F.col("lg_btts_rate") * 0.5,
        "home_overall": whole["home"], "away_overall": whole["away"], "overall_diff": whole["home"] - whole["away"],
    })
    return made.join(sizes, "league", "left")


def xg_features(df: DataFrame) -> DataFrame:
    """Logistic and exponential readings of both expected goals; 0.5 where one is missing. They know the match."""
    proxy = F.col("home_xg").isNull() | F.col("away_xg").isNull()
    h, a = _or("home_xg"), _or("away_xg")
    prob = lambda x: F.when(~proxy, 1 / (1 + F.exp(-1.5 * (x - 1)))).otherwise(0.5)
    return df.withColumns({
        "xg_is_proxy": proxy.cast("int"), "total_xg_real": h + a, "xg_diff_real": h - a, "home_score_prob": prob(h), "away_score_prob": prob(a), "btts_xprob": prob(h) * prob(a),
        "over25_xprob": F.when(~proxy, 1 - F.exp(-0.8 * (h + a))).otherwise(0.5), "xg_diff_abs": F.abs(h - a), "draw_xprob": 1 / (1 + 3 * F.abs(h - a)),
    })


def half_time(df: DataFrame) -> DataFrame:
    """Half-time totals and flags, goals expected after it from the league's mean, and those scored (no fewer than none)."""
    h, a = F.coalesce("ht_home_goals", F.lit(0)), F.coalesce("ht_away_goals", F.lit(0))
    full = F.coalesce("home_goals", F.lit(0)) + F.coalesce("away_goals", F.lit(0))
    return df.withColumns({"ht_total_goals": h + a, "ht_result_is_draw": (h == a).cast("int"), "ht_home_leading": (h > a).cast("int"), "ht_second_half_expected": F.col("lg_avg_goals") * 0.45, "second_half_goals": F.greatest(full - h - a, F.lit(0))})


def tiered_fill(df: DataFrame, tiers: dict[str, tuple[str, ...]], constants: dict[str, float]) -> DataFrame:
    """Null cells of each column from its tiers in order (a league baseline, another window), then its mean over all rows, then
    a constant. The mean is one small row."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in tiers])
    made = df.crossJoin(F.broadcast(means))
    return made.withColumns({c: F.coalesce(F.col(c).cast("double"), *[F.col(t).cast("double") for t in more], F.col(f"_m_{c}"), F.lit(constants[c])) for c, more in tiers.items()}).drop(*[f"_m_{c}" for c in tiers])


def market_targets_more(h: Column, a: Column) -> dict[str, Column]:
    """Ten targets of a result: clean sheets, goals of one side, goal ranges, home win and draw."""
    t = h + a
    made = {"home_clean_sheet": a == 0, "away_clean_sheet": h == 0, "home_over15": h > 1, "home_over05": h > 0, "away_over05": a > 0, "goals_2_3": t.between(2, 3), "goals_0_1": t <= 1, "goals_4_plus": t >= 4, "home_win": h > a, "is_draw": h == a}
    return {k: c.cast("int") for k, c in made.items()}


def half_targets(h: Column, a: Column, hh: Column, ha: Column) -> dict[str, Column]:
    """Targets of halves (result, over, both score), half-time and full-time combinations, handicaps and who scores first by proxy."""
    second = h + a - hh - ha
    made = {
        "ht_home": hh > ha, "ht_draw": hh == ha, "ht_away": hh < ha, "ht_over05": hh + ha > 0, "ht_over15": hh + ha > 1, "ht_btts": (hh > 0) & (ha > 0), "second_over05": second > 0, "second_over15": second > 1,
        "second_btts": (h - hh > 0) & (a - ha > 0), "second_more": second > hh + ha, "ht_ft_dh": (hh == ha) & (h > a), "ht_ft_da": (hh == ha) & (h < a), "handicap_home": h - 1 > a, "handicap_away": h - 1 < a,
        "win_by_one": F.abs(h - a) == 1, "first_goal_home": (hh > ha) | ((hh == ha) & (h > a)),
    }
    return {k: c.cast("int") for k, c in made.items()}


def five_types(diff: Column, home_elo: Column, away_elo: Column) -> Column:
    """Five kinds of matches: by the rating gap below 200, and above it by whether a side is over 1700. (Published labels in
    English; the fourth one's leading space is left out.)"""
    gap = F.abs(diff)
    return F.when(gap < 30, "derby").when(gap < 100, "nearly_even").when(gap < 200, "slight_favourite").when((home_elo > 1700) | (away_elo > 1700), "big_match").otherwise("clear_favourite")


def type_and_level(diff: Column, home_elo: Column) -> Column:
    """The signed rating difference in four bins and the home side's rating in three, as one label."""
    kind = F.when(diff < 50, "close").when(diff < 150, "slight").when(diff < 300, "clear").otherwise("dominant")
    return F.concat_ws("_", kind, F.when(home_elo < 1400, "weak").when(home_elo < 1600, "mid").otherwise("strong"))


def draw_groups(matches: DataFrame, edges: tuple[float, ...] = (0.22, 0.25, 0.28)) -> DataFrame:
    """league, draw_rate and the bin of it: right-closed, as a cut at ``edges`` gives it."""
    per = matches.groupBy("league").agg(F.avg((F.col("home_goals") == F.col("away_goals")).cast("double")).alias("draw_rate"))
    bin_ = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        bin_ = F.when(F.col("draw_rate") <= edges[k], k).otherwise(bin_)
    return per.withColumn("draw_group", bin_)


def string_id(name: Column) -> Column:
    """A stable id of text: its code points written one after another, as a number modulo 2^31. Digits are the number itself,
    null is 0. The fold multiplies by 10 to the length of each code point and stays below 2^53."""
    s, m = F.trim(name), 1 << 31
    step = lambda acc, c: F.pmod(acc * F.pow(F.lit(10), F.length(F.ascii(c).cast("string"))).cast("long") + F.ascii(c), F.lit(m))
    hashed = F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("long"), step)
    return F.when(name.isNull(), F.lit(0).cast("long")).when(s.rlike(r"^\d{1,18}$"), s.try_cast("long")).otherwise(hashed)


def category_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Codes from 0 in the order of the distinct values; null gets -1. Only distinct values are numbered, by ranges."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct()
    codes = row_numbers(values, [F.col("_v")], out)
    return df.join(codes, F.col(column) == F.col("_v"), "left").drop("_v").withColumn(out, F.coalesce(out, F.lit(-1)))


def page(df: DataFrame, order: list[str], limit: int, number: int) -> DataFrame:
    """Page ``number`` from the newest back, oldest first: the first ``limit`` of the last ``limit`` * (number + 1) rows, so a page
    beyond the end repeats the first rows, as published."""
    last = df.orderBy(*[F.desc(c) for c in order]).limit(limit * (number + 1))
    return last.orderBy(*order).limit(limit)


def grouped_names(names: DataFrame, column: str) -> DataFrame:
    """First words of names with how many names they start and what follows, in order."""
    first = F.split_part(F.col(column), F.lit(" "), F.lit(1))
    rest = F.trim(F.expr(f"substring(`{column}`, length(split_part(`{column}`, ' ', 1)) + 1)"))
    return names.groupBy(first.alias("country")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(rest)), ", ").alias("names"))


def big_groups(df: DataFrame, by: str, least: int) -> DataFrame:
    """Rows of groups with ``least`` rows or more."""
    return df.join(df.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(by), by, "left_semi")


def with_baselines(matches: DataFrame, least: int = 5, goals: float = 2.6, home: float = 0.45) -> DataFrame:
    """A league's rates over all its matches joined to each (they know the future, as published); defaults below ``least``."""
    h, a = F.col("home_goals"), F.col("away_goals")
    per = matches.groupBy("league").agg(F.count("*").alias("_n"), F.avg(h + a).alias("_g"), F.avg((h > a).cast("double")).alias("_h"))
    value = lambda c, d: F.when(F.col("_n") >= least, F.col(c)).otherwise(d)
    return matches.join(per, "league", "left").withColumns({"base_goals": value("_g", goals), "base_home": value("_h", home)}).drop("_n", "_g", "_h")


def team_index(long: DataFrame, rating: str | None = None) -> DataFrame:
    """Per team: the league it played most in its newest season (the smallest on ties), matches, mean goals and points, the results
    of its last ten (newest first), and the newest ``rating``."""
    newest = long.groupBy("team").agg(F.max("season").alias("_s"))
    league = long.join(newest, "team").where(F.col("season") == F.col("_s")).groupBy("team", "league").agg(F.count("*").alias("_c"))
    league = league.groupBy("team").agg(F.min_by("league", F.struct(-F.col("_c"), "league")).alias("league"))
    mark = F.when(F.col("gf") > F.col("ga"), "W").when(F.col("gf") == F.col("ga"), "D").otherwise("L")
    w = W.partitionBy("team").orderBy(F.desc("date"), F.desc("match_id"))
    last = long.withColumn("_rn", F.row_number().over(w)).where("_rn <= 10").groupBy("team").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", mark.alias("m")))), lambda x: x["m"]), "").alias("form10"))
    more = [F.max_by(rating, F.struct("date", "match_id")).alias(rating)] if rating else []
    per = long.groupBy("team").agg(F.count("*").alias("n"), F.avg("gf").alias("gf"), F.avg("ga").alias("ga"), F.avg("pts").alias("pts"), *more)
    return per.join(league, "team").join(last, "team")


def form_cache(long: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Per team the values of its newer side's last row, or of its other side's where they are 0 or missing.

    Nulls are skipped per column, as a last value of each side."""
    at = F.struct("date", "match_id")
    last = lambda c, side: F.max_by(c, F.when((F.col("is_home") == side) & F.col(c).isNotNull(), at))
    seen = lambda side: F.max(F.when(F.col("is_home") == side, at))
    per = long.groupBy("team").agg(seen(1).alias("_h"), seen(0).alias("_a"), *[last(c, s).alias(f"_{n}_{c}") for c in columns for n, s in (("h", 1), ("a", 0))])
    home = F.col("_a").isNull() | (F.col("_h") >= F.col("_a"))
    pick = lambda c: (F.when(home, F.col(f"_h_{c}")).otherwise(F.col(f"_a_{c}")), F.when(home, F.col(f"_a_{c}")).otherwise(F.col(f"_h_{c}")))
    return per.select("team", *[F.coalesce(F.nullif(pick(c)[0], F.lit(0)), F.nullif(pick(c)[1], F.lit(0)), *pick(c)).alias(c) for c in columns])


def fixture_window(matches: DataFrame, kind: str, today: str, limit: int = 50) -> DataFrame:
    """A report of ``limit`` matches around ``today``: finished (last 7 days, newest first), live (3 days to either side) or
    upcoming (from today on, the next first)."""
    days = F.datediff(F.to_date("date"), F.lit(today).cast("date"))
    if kind == "finished":
        return matches.where(days.between(-7, 0)).orderBy(F.desc("date"), F.desc("match_id")).limit(limit)
    if kind == "live":
        return matches.where(F.abs(days) <= 3).orderBy(F.abs(days), "date", "match_id").limit(limit)
    return matches.where(days >= 0).orderBy("date", "match_id").limit(limit)
