"""Adjustments of predictions (base rates, ratings, the winner's rule, calibrated classes) and reports on them."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators import fitted
from touchline.operators.evaluation import EPS, calibration_error, picked

#: How far probabilities move to the league's rates by the size of the rating difference, from the largest.
SHRINK = [(50, 0.15), (25, 0.25), (0, 0.35)]
#: Rating difference from which a side gains, its divisor and most, and the opponent's and the draw's share of what is taken.
AWAY_GAIN = [(100, 1200, 0.18, 0.55, 0.45), (50, 1500, 0.10, 0.55, 0.45), (25, 2500, 0.05, 0.5, 0.5)]
HOME_GAIN = [(100, 1500, 0.12, 0.55, 0.45), (50, 2500, 0.06, 0.5, 0.5)]


def _ladder(steps: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda rest, step: F.when(step[0], step[1]).otherwise(rest), reversed(steps), otherwise)


def shrunk_to_rates(df: DataFrame, elo_diff: str, home_rate: str, draw_rate: str) -> DataFrame:
    """p_h, p_d, p_a moved towards the league's rates, the less the clearer the ratings. Rates out of bounds (0.20 to 0.70 at home, 0.15 to
    0.40 drawn) count as 0.44 and 0.26, an away rate below 0.10 as 0.30. A null difference counts as 0."""
    bounded = lambda c, low, high, usual: F.when(F.col(c).between(low, high), F.col(c)).otherwise(usual)
    h, d = bounded(home_rate, 0.20, 0.70, 0.44), bounded(draw_rate, 0.15, 0.40, 0.26)
    a = F.when(1 - h - d < 0.10, 0.30).otherwise(1 - h - d)
    gap = F.abs(F.coalesce(F.col(elo_diff), F.lit(0.0)))
    share = _ladder([(gap > least, F.lit(s)) for least, s in SHRINK[:-1]], F.lit(SHRINK[-1][1]))
    moved = {x: F.col(f"p_{x}") * (1 - share) + r * share for x, r in (("h", h), ("d", d), ("a", a))}
    total = moved["h"] + moved["d"] + moved["a"]
    return df.withColumns({f"p_{x}": c / F.when(total > 0, total).otherwise(1.0) for x, c in moved.items()})


def boosted_by_rating(df: DataFrame, elo_diff: str) -> DataFrame:
    """p_h, p_d, p_a with the better rated side raised, none below 0.03, and normalised."""
    gap = F.coalesce(F.col(elo_diff), F.lit(0.0))
    gain = lambda table, size, k: _ladder([(size > t[0], (F.least(F.lit(t[2]), size / t[1]) * (1.0 if k is None else t[k]))) for t in table], F.lit(0.0))
    moved = {
        "h": F.col("p_h") + gain(HOME_GAIN, gap, None) - gain(AWAY_GAIN, -gap, 3),
        "d": F.col("p_d") - gain(HOME_GAIN, gap, 4) - gain(AWAY_GAIN, -gap, 4),
        "a": F.col("p_a") + gain(AWAY_GAIN, -gap, None) - gain(HOME_GAIN, gap, 3),
    }
    kept = {x: F.greatest(c, F.lit(0.03)) for x, c in moved.items()}
    total = kept["h"] + kept["d"] + kept["a"]
    return df.withColumns({f"p_{x}": c / total for x, c in kept.items()})


def winner(elo_diff: Column) -> Column:
    """H, D or A: a much better rated side with a fair probability, a draw where the sides are close, else the likeliest (home before away before draw)."""
    h, d, a = F.col("p_h"), F.col("p_d"), F.col("p_a")
    gap = F.coalesce(elo_diff, F.lit(0.0))
    strong = ((gap < -50) & (a > 0.25)) | ((gap < -100) & (a > 0.18))
    return F.when(strong, "A").when((gap > 50) & (h > 0.25), "H").when((F.abs(h - a) < 0.10) & (h < 0.48), "D").when((h >= a) & (h >= d), "H").when((a >= h) & (a >= d), "A").otherwise("D")


def calibrated_classes(cal: DataFrame, df: DataFrame, label: str, probabilities: list[str], least_gain: float = 1e-3, least_error: float = 0.02) -> DataFrame:
    """``df`` with each class's probability on the curve (logistic, beta or monotone) that has the least log-loss on ``cal``, normalised.

    They are used only if they gain ``least_gain`` in log-loss on ``cal`` and the first class's calibration error there is above
    ``least_error``; else the given ones are, normalised. ``calibrated`` tells which.
    ``cal`` is computed once and kept, in a part for each core, while the curves are fitted: each of their many steps sends the driver
    something for every part. ``df`` is read by the result only."""
    cal = cal.select(label, *probabilities).repartition(cal.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    curves = ["platt", "beta", "isotonic"]
    kept, both = [c for c in df.columns if c not in probabilities], cal.withColumn("_cal", F.lit(True)).unionByName(df.withColumn("_cal", F.lit(False)), allowMissingColumns=True)
    chosen = []
    for k, p in enumerate(probabilities):
        y = (F.col(label) == k).cast("int")
        train = cal.select(y.alias("_y1"), F.col(p).alias(p))
        made = fitted.isotonic(train, fitted.beta_curve(train, fitted.platt(train, both, "_y1", p, f"_platt{k}"), "_y1", p, f"_beta{k}"), "_y1", p, f"_isotonic{k}")
        own = made.where("_cal").agg(*[F.avg(-F.ln(F.greatest(F.when(y == 1, F.col(f"_{c}{k}")).otherwise(1 - F.col(f"_{c}{k}")), F.lit(EPS)))).alias(c) for c in curves]).first()
        best = min(curves, key=lambda c: own[c])
        both = made.withColumn(f"_c{k}", F.col(f"_{best}{k}")).drop(*[f"_{c}{k}" for c in curves])
        chosen.append(F.col(f"_c{k}"))
    raw = [F.col(p) for p in probabilities]
    shares = lambda cols: [c / F.when(sum(cols, F.lit(0.0)) > 0, sum(cols, F.lit(0.0))).otherwise(1.0) for c in cols]
    loss = lambda cols: F.avg(-F.ln(F.greatest(F.get(F.array(*cols), F.col(label).cast("int")), F.lit(EPS))))
    row = both.where("_cal").agg(loss(shares(chosen)).alias("after"), loss(raw).alias("before")).first()
    error = calibration_error(cal.select((F.col(label) == 0).cast("int").alias("y"), F.col(probabilities[0]).alias("p")), "y", "p").first()[0]
    cal.unpersist()
    use = bool(row["after"] <= row["before"] - least_gain and error > least_error)
    value = shares(chosen if use else raw)
    return both.where("not _cal").select(*kept, *[v.alias(p) for v, p in zip(value, probabilities, strict=True)], F.lit(use).alias("calibrated"))


def error_categories_of(recs: DataFrame) -> DataFrame:
    """kind, category, n, accuracy, confidence in what happened, and mean error: by league (10 records or more), by result, and by goals."""
    total, top = F.col("home_goals") + F.col("away_goals"), F.greatest("home_goals", "away_goals")
    goals = F.when(total >= 3, "3+").when(total == 0, "0-0").when(total == 1, "1-0 or 0-1").when(top == 2, "2-0 or 0-2").otherwise("1-1")
    own = F.when(F.col("result") == "H", F.col("p_h")).when(F.col("result") == "D", F.col("p_d")).otherwise(F.col("p_a"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("category")) for k, c in (("league", F.col("league")), ("result", F.col("result")), ("goals", goals))])
    rows = recs.select("correct", own.alias("_own"), F.inline(kinds))
    made = rows.groupBy("kind", "category").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("_own").alias("p_happened"), F.avg(1 - F.col("_own")).alias("mean_error"))
    return made.where((F.col("kind") != "league") | (F.col("n") >= 10))


def confidence_spread(recs: DataFrame) -> DataFrame:
    """n, mean and standard deviation (of the population) of the confidence."""
    return recs.agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("deviation"))


def small_kelly(p: Column, odds: Column, fraction: float = 0.20, cap: float = 0.05, least: float = 0.005) -> Column:
    """A stake from the edge over the implied probability, a ``fraction`` of it, ``cap`` at most; 0 below ``least``."""
    stake = F.least((p - 1 / odds) * fraction, F.lit(cap))
    return F.when((odds > 1) & (stake >= least), stake).otherwise(0.0)


def always_best(df: DataFrame, by: list[str], stake: float = 1.0) -> DataFrame:
    """A bet on the likeliest outcome of every match with odds: bets, hits, net return, and the published one, in which a lost bet costs nothing."""
    pick = F.when(F.col("p_h") >= F.col("p_d"), 0).when(F.col("p_a") >= F.col("p_h"), 2).otherwise(1)
    odds = F.get(F.array("odds_h", "odds_d", "odds_a"), pick)
    won = F.get(F.array(F.lit("H"), F.lit("D"), F.lit("A")), pick) == F.col("result")
    bets = df.select(*by, odds.alias("_o"), won.alias("_w")).where(F.col("_o") > 0)
    profit = F.when(F.col("_w"), stake * (F.col("_o") - 1))
    return bets.groupBy(*by).agg(F.count("*").alias("bets"), F.sum(F.col("_w").cast("long")).alias("hits"), (F.sum(F.coalesce(profit, F.lit(-stake))) / (F.count("*") * stake)).alias("net_roi"), (F.sum(F.coalesce(profit, F.lit(0.0))) / (F.count("*") * stake)).alias("published_roi"))


def best_bets(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group how many best bets (the outcome of the largest expected return) there were and how many came true, beside the picks."""
    value = [F.col(f"p_{x}") * F.col(f"odds_{x}") for x in "hda"]
    top = F.greatest(*value)
    bet = F.when(value[0] == top, "H").when(value[1] == top, "D").otherwise("A")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum((bet == F.col("result")).cast("long")).alias("best_bet_hits"), F.sum((picked() == F.col("result")).cast("long")).alias("pick_hits"))


def brier_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """The Brier score and the threshold that tuning by it gives: no threshold changes the score, so the first of the grid stays."""
    return df.agg(F.avg((F.col(score) - F.col(label).cast("double")) ** 2).alias("brier")).select(F.lit(0.25).alias("threshold"), "brier")


def coverage_with_missing(coverage: DataFrame, keys: list[str], absent: list[str]) -> DataFrame:
    """A coverage table (keys, feature, coverage) with rows of 0 for features that no source has, the lowest first."""
    zero = coverage.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(f) for f in absent])).alias("feature"), F.lit(0.0).alias("coverage"))
    return coverage.unionByName(zero)


def redundant_features(df: DataFrame, new: list[str], known: list[str]) -> DataFrame:
    """feature, nearest, corr and kind of each new column: the known one of the largest absolute correlation (the first on ties); new below 0.7,
    related below 0.9, else same. One aggregate; nulls count as 0; a column that does not vary is new."""
    x = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    row = df.agg(*[F.coalesce(F.abs(F.corr(x(a), x(b))), F.lit(0.0)).alias(f"{i}_{j}") for i, a in enumerate(new) for j, b in enumerate(known)])
    best = lambda i: F.reduce(F.array(*[F.struct(F.when(F.isnan(F.col(f"{i}_{j}")), 0.0).otherwise(F.col(f"{i}_{j}")).alias("corr"), F.lit(b).alias("nearest")) for j, b in enumerate(known)]), F.struct(F.lit(0.0).alias("corr"), F.lit("").alias("nearest")), lambda t, v: F.when(v["corr"] > t["corr"], v).otherwise(t))
    made = row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("feature"), best(i).alias("b")) for i, a in enumerate(new)])))
    return made.select("feature", "b.nearest", "b.corr", F.when(F.col("b.corr") < 0.7, "new").when(F.col("b.corr") < 0.9, "related").otherwise("same").alias("kind"))


def reused(requests: DataFrame, log: DataFrame, days: int = 14) -> DataFrame:
    """For each request (request_id, home, away, at) the newest logged prediction (id, home, away, at) of the same sides that is less than
    ``days`` old then; null where a new one is due."""
    known = log.select(F.col("id").alias("_id"), F.col("home").alias("_h"), F.col("away").alias("_a"), F.col("at").alias("_at"))
    age = F.datediff(F.to_date("at"), F.to_date("_at"))
    pairs = requests.join(known, (F.col("home") == F.col("_h")) & (F.col("away") == F.col("_a")) & (F.col("_at") < F.col("at")) & (age < days), "left")
    return pairs.groupBy("request_id").agg(F.max_by("_id", F.struct("_at", "_id")).alias("reused_id"))


def canonical(df: DataFrame, out: str = "id") -> DataFrame:
    """Merged matches in their final order, by date, sides and match_id, with a running id from 0."""
    from touchline.operators.ordering import row_numbers

    return row_numbers(df, [F.col(c) for c in ("date", "home_team", "away_team", "match_id")], out)
