"""Reports over scored rows: baselines, folds, benchmarks, picks, lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.operators.evaluation import brier, log_loss, picked

EDGES = (0.0, 0.03, 0.05, 0.08, 0.10, 0.15)


def naive_baselines(preds: DataFrame) -> DataFrame:
    """Rows, log-loss, that of the result rates alone (their entropy), Brier score, accuracy and that of always the most frequent result."""
    rate = {x: F.avg((F.col("result") == x).cast("double")).alias(x) for x in "HDA"}
    made = preds.agg(F.count("*").alias("n"), F.avg(log_loss()).alias("log_loss"), F.avg(brier()).alias("brier"), F.avg((picked() == F.col("result")).cast("double")).alias("accuracy"), *rate.values())
    entropy = -sum((F.when(F.col(x) > 0, F.col(x) * F.ln(x)).otherwise(0.0) for x in "HDA"), F.lit(0.0))
    return made.select("n", "log_loss", entropy.alias("naive_log_loss"), "brier", "accuracy", F.greatest("H", "D", "A").alias("majority"))


def hits_by_pick(preds: DataFrame) -> DataFrame:
    """Rows, hit rate and mean confidence of each predicted result."""
    return preds.groupBy(picked().alias("pick")).agg(F.count("*").alias("n"), F.avg((picked() == F.col("result")).cast("double")).alias("hit_rate"), F.avg(F.greatest("p_h", "p_d", "p_a")).alias("confidence"))


def confidence_buckets(preds: DataFrame, lo: float = 0.35, hi: float = 0.75, width: float = 0.05, least: int = 10) -> DataFrame:
    """Hit rate and mean confidence in buckets of five points with more than ``least`` rows."""
    top = F.greatest("p_h", "p_d", "p_a")
    made = preds.where((top >= lo) & (top < hi)).groupBy(F.floor((top - lo) / width + 1e-9).cast("int").alias("bucket"))
    made = made.agg(F.count("*").alias("n"), F.avg((picked() == F.col("result")).cast("double")).alias("hit_rate"), F.avg(top).alias("confidence"))
    return made.where(F.col("n") > least).select(F.round(F.lit(lo) + F.col("bucket") * width, 2).alias("from_p"), "n", "hit_rate", "confidence")


def flat_stakes(preds: DataFrame, edges: tuple[float, ...] = EDGES, least: int = 5) -> DataFrame:
    """Bets, profit, return and hit rate of one unit on the predicted result of every match whose largest edge is above each threshold;
    rows with odds of 1.01 or less are left out. A lost bet costs its stake. All thresholds are summed in one pass."""
    odds = [F.col(f"odds_{x}") for x in "hda"]
    edge = F.greatest(*[F.col(f"p_{x}") * F.col(f"odds_{x}") for x in "hda"]) - 1
    won = picked() == F.col("result")
    taken = F.when(picked() == "H", odds[0]).when(picked() == "D", odds[1]).otherwise(odds[2])
    gain = F.when(won, taken - 1).otherwise(-1.0)
    valid = preds.where((odds[0] > 1.01) & (odds[1] > 1.01) & (odds[2] > 1.01))
    sums = lambda e, i: [F.sum((edge > e).cast("long")).alias(f"n{i}"), F.sum(F.when(edge > e, gain)).alias(f"g{i}"), F.sum((won & (edge > e)).cast("long")).alias(f"h{i}")]
    row = valid.agg(*[c for i, e in enumerate(edges) for c in sums(e, i)])
    made = row.select(F.inline(F.array(*[F.struct(F.lit(e).alias("edge"), F.col(f"n{i}").alias("bets"), F.col(f"g{i}").alias("profit"), F.col(f"h{i}").alias("hits")) for i, e in enumerate(edges)])))
    return made.where(F.col("bets") >= least).select("edge", "bets", "profit", (F.col("profit") / F.col("bets")).alias("roi"), (F.col("hits") / F.col("bets")).alias("hit_rate"))


def majority_baseline(df: DataFrame, targets: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each yes/no market (probability, truth): log-loss, Brier score, accuracy at one half, and that of the more frequent answer."""
    aggs = []
    for k, (p, y) in targets.items():
        q, t = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9)), y.cast("double")
        aggs += [F.avg(-(t * F.ln(q) + (1 - t) * F.ln(1 - q))).alias(f"l_{k}"), F.avg((p - t) * (p - t)).alias(f"b_{k}"), F.avg(((p > 0.5) == y).cast("double")).alias(f"a_{k}"), F.avg(t).alias(f"r_{k}")]
    row = df.agg(*aggs)
    shown = [F.struct(F.lit(k).alias("market"), F.col(f"l_{k}").alias("log_loss"), F.col(f"b_{k}").alias("brier"), F.col(f"a_{k}").alias("accuracy"), F.greatest(F.col(f"r_{k}"), 1 - F.col(f"r_{k}")).alias("majority")) for k in targets]
    return row.select(F.inline(F.array(*shown)))


def walk_forward(df: DataFrame, start: str, months: int = 3, n: int = 4, least: int = 50, cal_share: float = 0.15) -> DataFrame:
    """fold, part (train, calibrate, validate) and the row's columns: a fold's rows are a quarter of months, what is before it trains, and
    the last of these, ``cal_share`` of them and ``least`` at least, calibrate. Folds of fewer than ``least`` rows are left out.

    Each row is in every later fold, so rows grow by the number of folds."""
    month = F.months_between(F.trunc("date", "month"), F.lit(start).cast("date"))
    own = F.floor(month / months).cast("int")
    made = df.withColumn("_own", own).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(F.col("_own") <= F.col("fold"))
    sizes = made.groupBy("fold").agg(F.sum((F.col("_own") == F.col("fold")).cast("long")).alias("_valid"), F.sum((F.col("_own") < F.col("fold")).cast("long")).alias("_train"))
    made = made.join(F.broadcast(sizes), "fold").where(F.col("_valid") >= least)  # a row for each fold
    # the newest training rows: counted per day first, so that only the day on the edge is ranked row by row
    day = F.to_date("date")
    days = made.where(F.col("_own") < F.col("fold")).groupBy("fold", day.alias("_d")).agg(F.count("*").alias("_c"))
    later = days.withColumn("_later", F.sum("_c").over(W.partitionBy("fold").orderBy(F.desc("_d"))) - F.col("_c")).select(F.col("fold").alias("_f"), "_d", "_later")
    made = made.join(F.broadcast(later), (F.col("fold") == F.col("_f")) & (day == F.col("_d")), "left")
    within = F.row_number().over(W.partitionBy("fold", day).orderBy(F.desc("date"), F.desc("match_id")))
    cal = F.greatest(F.lit(least), F.floor(F.col("_train") * cal_share))
    part = F.when(F.col("_own") == F.col("fold"), "validate").when(F.col("_later") + within <= cal, "calibrate").otherwise("train")
    return made.withColumn("part", part).select("fold", "part", *df.columns)


def fold_scores(folds: DataFrame) -> DataFrame:
    """model, fold, n, log-loss, Brier score and accuracy on the validation rows of the given probabilities and of the training rates."""
    rates = folds.where("part <> 'validate'").groupBy("fold").agg(*[F.avg((F.col("result") == x).cast("double")).alias(f"_r{x}") for x in "HDA"])
    valid = folds.where("part = 'validate'").join(F.broadcast(rates), "fold")
    score = lambda df, name: df.groupBy("fold").agg(F.count("*").alias("n"), F.avg(log_loss()).alias("log_loss"), F.avg(brier()).alias("brier"), F.avg((picked() == F.col("result")).cast("double")).alias("accuracy")).withColumn("model", F.lit(name))
    naive = valid.withColumns({"p_h": F.col("_rH"), "p_d": F.col("_rD"), "p_a": F.col("_rA")})
    return score(valid, "given").unionByName(score(naive, "rates"))


def fold_summary(scores: DataFrame) -> DataFrame:
    """Per model the rows of all folds and the mean of each measure over folds, the least log-loss first."""
    return scores.groupBy("model").agg(F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in ("log_loss", "brier", "accuracy")]).orderBy("log_loss")


def betting_folds(folds: DataFrame, threshold: float = 0.03) -> DataFrame:
    """The betting report of each fold's validation rows, flat: bets, hits, net return and the published one."""
    from touchline.operators.evaluation import betting_report

    valid = folds.where("part = 'validate'")
    net, published = betting_report(valid, threshold, by=["fold"]), betting_report(valid, threshold, compat=True, by=["fold"])
    return net.withColumnRenamed("roi", "net_roi").join(published.select("fold", F.col("roi").alias("published_roi")), "fold")


def pick_report(preds: DataFrame) -> DataFrame:
    """Per league: accuracy, mean probability of the pick when right and when wrong, and how many of each."""
    top, right = F.greatest("p_h", "p_d", "p_a"), picked() == F.col("result")
    return preds.groupBy("league").agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.avg(F.when(right, top)).alias("p_right"), F.avg(F.when(~right, top)).alias("p_wrong"), F.sum((top >= 0.6).cast("long")).alias("sure"), F.sum((right & (top >= 0.6)).cast("long")).alias("sure_right"))


def league_overview(matches: DataFrame, names: DataFrame) -> DataFrame:
    """Per resolved league name: matches, teams, goals and result rates, the most matches first. ``names`` has league and name."""
    h, a = F.col("home_goals"), F.col("away_goals")
    named = matches.join(F.broadcast(names), "league", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("League "), F.col("league").cast("string"))))
    avg = lambda c: F.avg(c.cast("double"))
    return named.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("home_team_id").alias("teams"), avg(h + a).alias("goals"), avg(h > a).alias("home_rate"), avg(h == a).alias("draw_rate"), F.max("date").alias("last")).orderBy(F.desc("n"), "name")


def settled(predictions: DataFrame, results: DataFrame) -> DataFrame:
    """Every stored prediction (prediction_id, match_id, p_h, p_d, p_a) of a finished match with result, log-loss and Brier score."""
    made = predictions.join(results.select("match_id", "result"), "match_id")
    return made.withColumns({"log_loss": log_loss(), "brier": brier()})


def prediction_log(log: DataFrame, meetings: DataFrame, cap: int = 200) -> DataFrame:
    """A log (id, home, away, at, match_date) with null match dates filled from the pair's last meeting in either direction, the newest
    entry of each (home, away), and of these the newest ``cap``."""
    pair = lambda df, h, a: df.withColumns({"_lo": F.least(h, a), "_hi": F.greatest(h, a)})
    last = pair(meetings, "home_team_id", "away_team_id").groupBy("_lo", "_hi").agg(F.max("date").alias("_last"))
    made = pair(log, "home", "away").join(last, ["_lo", "_hi"], "left").withColumn("match_date", F.coalesce("match_date", "_last")).drop("_lo", "_hi", "_last")
    newest = made.withColumn("_rn", F.row_number().over(W.partitionBy("home", "away").orderBy(F.desc("at"), F.desc("id")))).where("_rn = 1").drop("_rn")
    return newest.orderBy(F.desc("at"), F.desc("id")).limit(cap)
