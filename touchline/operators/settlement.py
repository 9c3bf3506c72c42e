"""Coupon settlement, market checks against recent form, flips of weak predictions, and model registry states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.operators.evaluation import picked

#: For the bands of expected corners (below 7.5, below 9.5, rest), factor and bound of P(over line).
#: Bounds are upper ones in the first two bands and lower ones in the last.
CORNER_BANDS = {
    "corner_over75": ((0.6, 0.30), (1.0, 0.65), (1.0, 0.60)),
    "corner_over85": ((0.5, 0.20), (1.0, 0.45), (1.0, 0.40)),
    "corner_over95": ((0.4, 0.10), (0.7, 0.25), (1.0, 0.25)),
}


def settled_legs(preds: DataFrame, lines: dict[str, tuple[Column, Column]], key: str = "match_id") -> DataFrame:
    """A row per market of each coupon: market, pick, p, won. ``lines`` gives P(yes) and what happened for yes/no markets;
    a market whose outcome is null is not known and is left out. 1X2 and double chance come from p_h, p_d, p_a and result.
    Double chance takes 12 first on ties, then 1X."""
    sums = {"12": F.col("p_h") + F.col("p_a"), "1X": F.col("p_h") + F.col("p_d"), "X2": F.col("p_d") + F.col("p_a")}
    best = F.greatest(*sums.values())
    pair = F.when(sums["12"] == best, "12").when(sums["1X"] == best, "1X").otherwise("X2")
    sign = F.when(F.col("result") == "H", "1").when(F.col("result") == "D", "X").otherwise("2")
    pick = F.when(picked() == "H", "1").when(picked() == "D", "X").otherwise("2")
    leg = lambda name, chosen, p, won: F.struct(F.lit(name).alias("market"), chosen.alias("pick"), p.cast("double").alias("p"), won.alias("won"))
    legs = [leg("1x2", pick, F.greatest("p_h", "p_d", "p_a"), pick == sign), leg("double_chance", pair, best, F.contains(pair, sign))]
    for name, (p, truth) in lines.items():
        legs.append(leg(name, F.when(p >= 0.5, "yes").otherwise("no"), F.greatest(p, 1 - p), (p >= 0.5) == truth))
    return preds.select(key, F.explode(F.filter(F.array(*legs), lambda x: x["won"].isNotNull())).alias("_leg")).select(key, "_leg.*")


def coupon_scores(legs: DataFrame, key: str = "match_id") -> DataFrame:
    """Markets won, markets known and the score "won/known" of each coupon."""
    per = legs.groupBy(key).agg(F.sum(F.col("won").cast("long")).alias("won"), F.count("*").alias("markets"))
    return per.withColumn("score", F.concat_ws("/", F.col("won").cast("string"), F.col("markets").cast("string")))


def recent_means(matches: DataFrame, by: str, values: dict[str, Column], n: int = 20) -> DataFrame:
    """Means over the last ``n`` matches of each ``by``. Spark keeps ``n`` rows of a group before the shuffle already."""
    w = W.partitionBy(by).orderBy(F.desc("date"), F.desc("match_id"))
    rows = matches.select(by, "date", "match_id", *[c.cast("double").alias(k) for k, c in values.items()]).withColumn("_rn", F.row_number().over(w))
    return rows.where(F.col("_rn") <= n).groupBy(by).agg(*[F.avg(k).alias(k) for k in values])


def blend(team: Column, league: Column, weight: float = 0.7, rest: float = 0.3) -> Column:
    """Team and league means mixed; whichever is there where one is 0 or missing. ``rest`` is its own number, as 1 - 0.7 is not 0.3
    and differences of 0.15 or 0.2 lie on a threshold then."""
    t, g = F.coalesce(team, F.lit(0.0)), F.coalesce(league, F.lit(0.0))
    return F.when((t > 0) & (g > 0), weight * t + rest * g).when(t > 0, t).otherwise(g)


def check_markets(preds: DataFrame, history: DataFrame, n: int = 20) -> DataFrame:
    """``preds`` with its market columns (btts, over15, over25, over35, corner_total, corner_over75/85/95, p_h, p_d, p_a)
    pulled towards what both teams and the league did in their last ``n`` matches of ``history``."""
    h, a, c = F.col("home_goals"), F.col("away_goals"), F.col("home_corners")
    both, over = ((h > 0) & (a > 0)).cast("int"), (h + a > 2).cast("int")
    home = recent_means(history, "home_team_id", {"h_gf": h, "h_btts": both, "h_o25": over, "h_corners": c}, n)
    away = recent_means(history, "away_team_id", {"a_gf": a, "a_btts": both, "a_o25": over, "a_corners": F.col("away_corners")}, n)
    league = recent_means(history, "league", {"l_hg": h, "l_ag": a, "l_btts": both, "l_o25": over, "l_corners": c + F.col("away_corners")}, n)
    own = preds.columns
    df = preds.join(home, "home_team_id", "left").join(away, "away_team_id", "left").join(league, "league", "left")
    stat = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    df = df.withColumns({"_hg": blend(stat("h_gf"), stat("l_hg")), "_ag": blend(stat("a_gf"), stat("l_ag")), "_c": blend(stat("h_corners") + stat("a_corners"), stat("l_corners"))})
    for name, pair in (("btts", "btts"), ("over25", "o25")):
        want = blend((stat(f"h_{pair}") + stat(f"a_{pair}")) / 2, stat(f"l_{pair}"))
        df = df.withColumn(name, F.when((want > 0) & (F.abs(F.col(name) - want) > 0.15), (F.col(name) + want) / 2).otherwise(F.col(name)))
    off = (F.col("_c") > 0) & (F.col("corner_total") > 0) & (F.abs(F.col("corner_total") - F.col("_c")) / F.nullif("_c", F.lit(0.0)) > 0.2)
    df = df.withColumns({
        "over15": F.when(F.col("over15") < F.col("over25"), F.least(F.col("over25") * 1.2, F.lit(0.98))).otherwise(F.col("over15")),
        "over35": F.when(F.col("over35") > F.col("over25"), F.greatest(F.col("over25") * 0.6, F.lit(0.02))).otherwise(F.col("over35")),
        "corner_total": F.when(off, 0.4 * F.col("corner_total") + 0.6 * F.col("_c")).otherwise(F.col("corner_total")),
    })
    t = F.col("corner_total")
    for name, (low, mid, high) in CORNER_BANDS.items():
        df = df.withColumn(name, F.when(t < 7.5, F.least(F.col(name) * low[0], F.lit(low[1]))).when(t < 9.5, F.least(F.col(name) * mid[0], F.lit(mid[1]))).otherwise(F.greatest(F.col(name) * high[0], F.lit(high[1]))))
    ratio = F.when((F.col("_hg") > 0) & (F.col("_ag") > 0), F.col("_hg") / F.nullif("_ag", F.lit(0.0)))
    up = F.when((ratio > 1.8) & (F.col("p_h") < 0.5), F.least(F.lit(0.08), (ratio - 1.8) * 0.05)).otherwise(0.0)
    down = F.when((ratio < 0.55) & (F.col("p_a") < 0.45), F.least(F.lit(0.08), (0.55 - ratio) * 0.05)).otherwise(0.0)
    raw = {"p_h": F.col("p_h") + up - down / 2, "p_d": F.col("p_d") - (up + down) / 2, "p_a": F.col("p_a") + down - up / 2}
    df = normalised(df.withColumns(raw), 1e-12)
    bounds = {"p_h": 0.95, "p_d": 0.5, "p_a": 0.95}
    return normalised(df.withColumns({k: F.greatest(F.lit(0.02), F.least(F.lit(b), F.col(k))) for k, b in bounds.items()})).select(*own)


def normalised(df: DataFrame, near: float = -1.0) -> DataFrame:
    """p_h, p_d, p_a with sum 1; as they are where the sum is not positive, or within ``near`` of 1 already."""
    total = F.col("p_h") + F.col("p_d") + F.col("p_a")
    return df.withColumns({f"p_{x}": F.when((total > 0) & (F.abs(total - 1) > near), F.col(f"p_{x}") / total).otherwise(F.col(f"p_{x}")) for x in "hda"})


def flips(recs: DataFrame, kind: Column, least: int = 50, weak: float = 0.4, gap: float = 0.1, sure: float = 0.65, shift: float = 0.15) -> DataFrame:
    """``recs`` (records with predicted, correct, confidence) with ``flip``: the result that probability moves to, or null.

    A match type's hit rate by predicted class tells where predictions are weak; the better of the two other classes takes
    over if its rate (or its own probability, below 10 records) is higher by ``gap``. Confident predictions stay. p_h, p_d, p_a
    then move by ``shift`` and are normalised. The rates are a row per type and class: three of each at most."""
    df = recs.withColumn("_type", kind)
    hit = lambda x: F.avg(F.when(F.col("predicted") == x, F.col("correct")))
    rates = df.groupBy("_type").agg(*[c for x in "HDA" for c in (hit(x).alias(f"_r{x}"), F.count(F.when(F.col("predicted") == x, 1)).alias(f"_n{x}"))])
    df = df.join(rates, df["_type"].eqNullSafe(rates["_type"])).drop("_type")
    of = lambda tag: F.when(F.col("predicted") == "H", F.col(f"_{tag}H")).when(F.col("predicted") == "D", F.col(f"_{tag}D")).otherwise(F.col(f"_{tag}A"))
    alt = {x: F.when(F.col("predicted") != x, F.when(F.col(f"_n{x}") >= 10, F.col(f"_r{x}")).otherwise(F.col(f"p_{x.lower()}"))) for x in "HDA"}
    best = F.greatest(*alt.values())
    which = F.when(alt["H"] == best, "H").when(alt["D"] == best, "D").otherwise("A")
    doubt = (of("n") >= least) & (of("r") < weak) & (F.col("confidence") <= sure) & (best - of("r") >= gap)
    df = df.withColumn("flip", F.when(doubt, which))
    moved = {f"p_{x}": F.col(f"p_{x}") + F.when(F.col("flip").isNull(), 0.0).when(F.col("flip") == x.upper(), shift).otherwise(-shift / 2) for x in "hda"}
    return normalised(df.withColumns(moved)).select(*recs.columns, "flip")


def registry_states(log: DataFrame) -> DataFrame:
    """The status of each (model_id, version) after a log of promotions (model_id, version, at, event_id, to_status).

    candidate -> staging -> production; other moves are refused and change nothing. The version of a model promoted to
    production last holds it, those before are archived. A version's first move to staging is always taken, and its first
    move to production after that, so no fold over the log is needed."""
    w = W.partitionBy("model_id", "version").orderBy("at", "event_id").rowsBetween(W.unboundedPreceding, -1)
    at = F.struct("at", "event_id")
    staged = F.coalesce(F.max((F.col("to_status") == "staging").cast("int")).over(w), F.lit(0)) == 1
    moves = log.withColumn("_up", F.when((F.col("to_status") == "production") & staged, at))
    per = moves.groupBy("model_id", "version").agg(F.min("_up").alias("up"), F.max((F.col("to_status") == "staging").cast("int")).alias("staged"))
    last = F.max("up").over(W.partitionBy("model_id"))
    status = F.when(F.col("up") == last, "production").when(F.col("up").isNotNull(), "archived").when(F.col("staged") == 1, "staging").otherwise("candidate")
    return per.select("model_id", "version", status.alias("status"))
