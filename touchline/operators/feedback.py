"""Error feedback: records, categories, patterns, memory."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.operators.evaluation import log_loss, p_of_result, picked


def records(preds: DataFrame) -> DataFrame:
    """Per prediction: predicted result, correct, error margin (largest less actual probability), log-loss."""
    return preds.withColumns({"predicted": picked(), "confidence": F.greatest("p_h", "p_d", "p_a"), "correct": (picked() == F.col("result")).cast("int"), "error_margin": F.greatest("p_h", "p_d", "p_a") - p_of_result(), "loss": log_loss()})


def by_category(recs: DataFrame, key: Column, least: int = 10) -> DataFrame:
    return recs.groupBy(key.alias("category")).agg(F.count("*").alias("n"), F.round(1 - F.avg("correct"), 6).alias("error_rate")).where(F.col("n") >= least)


def confidence_histogram(recs: DataFrame, bins: int = 10) -> DataFrame:
    return recs.groupBy(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


def _stirling_error(x: Column) -> Column:
    """ln x! less Stirling's formula: from the factorial below 16, by the series from there."""
    x, small = x.cast("double"), F.greatest(F.least(x, F.lit(15)), F.lit(1)).cast("int")
    exact = F.ln(F.factorial(small).cast("double")) - ((small + 0.5) * F.ln(small.cast("double")) - small + 0.5 * math.log(2 * math.pi))
    y = F.greatest(x, F.lit(16.0))
    return F.when(x < 16, exact).otherwise((1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (y * y)) / (y * y)) / (y * y)) / y)


def _log_pmf(k: Column, n: Column, p: Column) -> Column:
    """ln P(X = k) by Loader's saddle point, which keeps its digits at any n."""
    away = lambda x, mean: x * F.log1p((x - mean) / mean) + mean - x
    inner = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - away(k, n * p) - away(n - k, n * (1 - p)) + 0.5 * F.ln(n / (2 * math.pi * k * (n - k)))
    return F.when(k >= n, n * F.ln(p)).otherwise(inner)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) of a binomial, the same sum at every n: the first term by logs, each next one from the last.

    The smaller tail is summed, up to 12 standard deviations and 60 terms from its first one; those further out are
    below 1e-17 of it."""
    k, n, p = k.cast("double"), n.cast("double"), p.cast("double")
    high = k >= n * p
    at, q = F.when(high, k).otherwise(n - k + 1), F.when(high, p).otherwise(1 - p)
    terms = F.least(n - at, F.ceil(12 * F.sqrt(n * q * (1 - q))) + 60).cast("int")
    step = lambda acc, j: F.struct((acc["term"] * (n - at - j) / (at + j + 1) * q / (1 - q)).alias("term"), (acc["total"] + acc["term"]).alias("total"))
    ratio = F.aggregate(F.sequence(F.lit(0), terms), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")), step, lambda acc: acc["total"])
    tail = F.exp(_log_pmf(at, n, q)) * ratio
    return F.when(k <= 0, 1.0).when((k > n) | (p <= 0), 0.0).when(p >= 1, 1.0).when(high, tail).otherwise(1 - tail)


def pattern_keys() -> list[Column]:
    """(kind, value) of every group that a record belongs to; a match counts for both of its teams."""
    goals, sure = F.col("home_goals") + F.col("away_goals"), F.col("confidence")
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    return [
        pair("all", F.lit("")), pair("league", F.col("league")), pair("team", F.col("home_team_id")), pair("team", F.col("away_team_id")), pair("result", F.col("result")),
        pair("goals", F.when(goals <= 1, "0-1").when(goals <= 3, "2-3").when(goals > 3, "4+")),
        pair("confidence", F.when(sure < 0.5, "<0.5").when(sure < 0.7, "0.5-0.7").when(sure < 0.9, "0.7-0.9").when(sure >= 0.9, ">=0.9")),
        pair("month", F.month("date")),
    ]


#: A group's error rate must be over so many times the overall one.
FACTORS = {"league": 1.2, "team": 1.3, "result": 1.25, "goals": 1.3, "month": 1.3}


def patterns(recs: DataFrame, factors: dict[str, float] = FACTORS, sure_rate: float = 0.15, least: int = 20, level: float = 0.05) -> DataFrame:
    """Groups of the six kinds that err more than their share, by a one-sided exact test below ``level``, worst first.

    Confidence groups count from 0.7 on, with over ``sure_rate`` errors and a severity of a rate over 0.3; the others by
    ``factors``, with the excess over the overall rate. Severity is 1 at most, confidence is 1 - p. Months need twice
    ``least`` dated records."""
    wrong = (1 - F.col("correct")).alias("wrong")
    per = recs.select(wrong, F.explode(F.array(*pattern_keys())).alias("g")).where("g.value is not null").groupBy("g.kind", "g.value").agg(F.count("*").alias("n"), F.sum("wrong").cast("long").alias("errors"))
    whole = per.where("kind = 'all'").select((F.col("errors") / F.col("n")).alias("base"))
    dated = per.where("kind = 'month'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("dated"))
    rate, base, kind = F.col("errors") / F.col("n"), F.col("base"), F.col("kind")
    over = [(kind == k) & (rate > base * f) for k, f in factors.items()]
    sure = (kind == "confidence") & F.col("value").isin("0.7-0.9", ">=0.9") & (rate > sure_rate)
    made = per.where((F.col("n") >= least) & (kind != "all")).crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(dated)).where(reduce(or_, over, sure)).where((kind != "month") | (F.col("dated") >= 2 * least))
    made = made.withColumn("p", binomial_tail(F.col("errors"), F.col("n"), base)).where(F.col("p") < level)
    severity = F.least(F.lit(1.0), F.when(kind == "confidence", rate / 0.3).otherwise((rate - base) / base))
    r6 = lambda name, c: F.round(c, 6).alias(name)
    shown = made.select("kind", "value", "n", "errors", r6("rate", rate), r6("expected", base), r6("severity", severity), r6("p_value", F.col("p")), r6("confidence", 1 - F.col("p")), (severity * (1 - F.col("p"))).alias("_by"))
    return shown.orderBy(F.desc("_by"), "kind", "value").drop("_by")


def error_memory(recs: DataFrame, last: int = 500, least: int = 3) -> DataFrame:
    """Error rates per team over a league's last ``last`` predictions; 0 below ``least`` rows, warning above 0.4."""
    w = W.partitionBy("league").orderBy(F.desc("date"), F.desc("match_id"))
    rows = recs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last)
    teams = rows.select("league", (1 - F.col("correct")).alias("wrong"), F.explode(F.array("home_team_id", "away_team_id")).alias("team"))
    per = teams.groupBy("league", "team").agg(F.count("*").alias("n"), F.sum("wrong").cast("long").alias("errors"))
    rate = F.when(F.col("n") >= least, F.col("errors") / F.col("n")).otherwise(0.0)
    return per.withColumn("rate", F.round(rate, 6)).withColumn("warning", rate > 0.4)


def z_adjustment(recs: DataFrame, key: Column, rate: float = 0.3, cap: float = 0.04, least: int = 30) -> DataFrame:
    """Shift of the predicted class per match type where hits differ from stated confidence (|z| > 1.96)."""
    per = recs.groupBy(key.alias("type"), "predicted").agg(F.count("*").alias("n"), F.avg("correct").alias("hit"), F.avg("confidence").alias("conf"))
    z = (F.col("hit") - F.col("conf")) / F.nullif(F.sqrt(F.col("conf") * (1 - F.col("conf")) / F.col("n")), F.lit(0.0))
    shift = F.greatest(F.lit(-cap), F.least(F.lit(cap), rate * (F.col("hit") - F.col("conf"))))
    return per.select("type", "predicted", "n", F.round(z, 6).alias("z"), F.round(F.when((F.abs(z) > 1.96) & (F.col("n") >= least), shift).otherwise(0.0), 6).alias("shift"))
