"""From probabilities to decisions: count markets, blends, ensembles, draw rules, recommendations, policies, bias and plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions import bound, poisson_pmf
from touchline.operators.evaluation import EPS, picked


def negative_binomial_pmf(mean: Column, spread: float | Column, most: int) -> Column:
    """P(0) to P(most) with variance mean + mean^2 / spread, by recurrence."""
    q = mean / (mean + spread)
    step = lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * (k - 1 + spread) / k * q))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.array(F.pow(1 - q, spread if isinstance(spread, Column) else F.lit(float(spread)))), step)


def convolved(a: Column, b: Column, most: int) -> Column:
    """Distribution of the sum of two counts, from 0 to ``most``."""
    at = lambda c, i: F.coalesce(F.get(c, i), F.lit(0.0))
    sums = lambda v: F.transform(F.sequence(F.lit(0), F.lit(most)), lambda n: F.aggregate(F.sequence(F.lit(0), n), F.lit(0.0), lambda s, i: s + at(v["a"], i) * at(v["b"], n - i)))
    return bound(sums, a=a, b=b)


def count_overs(df: DataFrame, home: str, away: str, lines: tuple[int, ...], most: int = 20, spread: float | None = None) -> DataFrame:
    """``df`` with over<line>5 of the sum of both sides' counts, Poisson or (with ``spread``) negative binomial.

    Sides end at ``most``; what lies beyond counts as over, as the sum up to a line is all that is taken off."""
    pmf = (lambda c: negative_binomial_pmf(F.col(c), spread, most)) if spread else (lambda c: poisson_pmf(F.col(c), most))
    made = df.withColumns({"_h": pmf(home), "_a": pmf(away)}).withColumn("_t", convolved(F.col("_h"), F.col("_a"), max(lines)))
    below = lambda k: F.aggregate(F.slice("_t", 1, k + 1), F.lit(0.0), lambda s, x: s + x)
    return made.withColumns({f"over{k}5": 1 - below(k) for k in lines}).drop("_h", "_a", "_t")


def blended_overs(df: DataFrame, total: Column, corners: Column, league_corners: Column) -> DataFrame:
    """Model and Poisson overs mixed (0.6 and 0.4; halves at 1.5) and the corner mean (0.6 team, 0.4 league, 7 to 14)."""
    below = {1: F.exp(-total) * (1 + total), 2: F.exp(-total) * (1 + total + total * total / 2), 3: F.exp(-total) * (1 + total + total * total / 2 + total * total * total / 6)}
    mix = {k: (0.5 if k == 1 else 0.6) * F.col(f"ml_over{k}5") + (0.5 if k == 1 else 0.4) * (1 - below[k]) for k in below}
    return df.withColumns({**{f"over{k}5": c for k, c in mix.items()}, "corner_mean": F.greatest(F.lit(7.0), F.least(F.lit(14.0), 0.6 * corners + 0.4 * league_corners))})


def weighted_mean(parts: list[tuple[float, dict[str, Column]]], names: tuple[str, ...]) -> dict[str, Column]:
    """Weighted means per field; a model that lacks a field has no weight in it."""
    out = {}
    for n in names:
        top = sum((F.coalesce(p[n] * w, F.lit(0.0)) for w, p in parts), F.lit(0.0))
        out[n] = top / F.nullif(sum((F.when(p[n].isNotNull(), w).otherwise(0.0) for w, p in parts), F.lit(0.0)), F.lit(0.0))
    return out


def ensemble_weights(df: DataFrame, models: list[str], step: int = 10) -> DataFrame:
    """Each point of the weight simplex in steps of 1/``step`` with its log-loss; ``best`` marks the least (first on ties).

    ``df`` has the probability of what happened by each model; all candidates are summed in one pass, without a join."""
    points = [[]]
    for k in range(len(models)):
        last = k == len(models) - 1
        points = [p + [x] for p in points for x in ([step - sum(p)] if last else range(step - sum(p) + 1))]
    mean = lambda p: sum((F.col(m) * (x / step) for m, x in zip(models, p, strict=True)), F.lit(0.0))
    row = df.agg(*[F.avg(-F.ln(F.greatest(mean(p), F.lit(EPS)))).alias(f"c{i}") for i, p in enumerate(points)])
    shown = [F.struct(*[F.lit(x / step).alias(f"w_{m}") for m, x in zip(models, p, strict=True)], F.round(F.col(f"c{i}"), 9).alias("log_loss"), F.lit(i).alias("_i")) for i, p in enumerate(points)]
    made = row.select(F.inline(F.array(*shown)))
    top = F.min(F.struct("log_loss", "_i")).over(W.partitionBy(F.lit(1)))  # a row for each candidate
    return made.withColumn("best", F.struct("log_loss", "_i") == top).drop("_i")


def temperature_grid(df: DataFrame, values: tuple[float, ...] = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0)) -> DataFrame:
    """Log-loss of p_h, p_d, p_a at each temperature (powers 1 / T, normalised), and which is best."""
    loss = []
    for i, t in enumerate(values):
        raw = {x: F.pow(F.greatest(F.col(f"p_{x}"), F.lit(EPS)), F.lit(1 / t)) for x in "hda"}
        own = F.when(F.col("result") == "H", raw["h"]).when(F.col("result") == "D", raw["d"]).otherwise(raw["a"])
        loss.append(F.avg(-F.ln(own / (raw["h"] + raw["d"] + raw["a"]))).alias(f"c{i}"))
    made = df.agg(*loss).select(F.inline(F.array(*[F.struct(F.lit(t).alias("temperature"), F.round(F.col(f"c{i}"), 9).alias("log_loss")) for i, t in enumerate(values)])))
    return made.withColumn("best", F.struct("log_loss", "temperature") == F.min(F.struct("log_loss", "temperature")).over(W.partitionBy(F.lit(1))))


def draw_override(df: DataFrame, draw_model: Column, league_rate: Column) -> DataFrame:
    """p_h, p_d, p_a with the draw raised where its model and the league's draw rate say so: above 0.22, 0.26 or 0.30 in leagues
    with many (over 0.28), some or few (under 0.22) draws if the sides are within 0.25, and above 0.40 anywhere."""
    close = F.abs(F.col("p_h") - F.col("p_a")) < 0.25
    least = F.when(league_rate > 0.28, 0.22).when(league_rate >= 0.22, 0.26).otherwise(0.30)
    over = ((draw_model > least) & close) | (draw_model > 0.40)
    raised = F.least(F.lit(0.42), F.greatest(F.col("p_d"), draw_model) + F.greatest(F.lit(0.0), 0.32 - F.col("p_d")) * 0.4)
    made = df.withColumns({"draw_override": F.coalesce(over, F.lit(False)), "p_d": F.when(over, raised).otherwise(F.col("p_d"))})
    total = F.when(F.col("draw_override"), F.col("p_h") + F.col("p_d") + F.col("p_a")).otherwise(1.0)
    return made.withColumns({f"p_{x}": F.col(f"p_{x}") / total for x in "hda"})


def recommendations(df: DataFrame, key: str, tips: list[tuple[str, str, Column]], least: float = 0.70, most: int = 12) -> DataFrame:
    """A row for each of a match's tips (market, pick, confidence in per cent) of at least ``least``, the surest first, ``most`` at most.

    Of tips of one market the first in the list counts."""
    items, seen = [], {}
    for place, (market, pick, p) in enumerate(tips):
        earlier = reduce(lambda a, b: a | b, seen.get(market, []), F.lit(False))
        good = F.coalesce(p >= least, F.lit(False))
        items.append(F.when(good & ~earlier, F.struct((-F.round(p * 100, 1)).alias("by"), F.lit(place).alias("place"), F.lit(market).alias("market"), F.lit(pick).alias("pick"))))
        seen.setdefault(market, []).append(good)
    ranked = F.slice(F.array_sort(F.filter(F.array(*items), lambda x: x.isNotNull())), 1, most)
    made = df.select(key, F.posexplode(ranked).alias("rank", "t"))
    return made.select(key, (F.col("rank") + 1).alias("rank"), F.col("t.market").alias("market"), F.col("t.pick").alias("pick"), (-F.col("t.by")).alias("confidence"))


def payload(df: DataFrame, league_matches: Column) -> DataFrame:
    """confidence, spread (largest less smallest probability, a measured sign of agreement), whether the match is playable
    (confidence 0.60 and a league of 1,000 or more), and a JSON payload of the probabilities."""
    sure = F.greatest("p_h", "p_d", "p_a")
    r = lambda c: F.round(F.col(c), 4)
    body = F.to_json(F.struct(F.struct(r("p_h").alias("home"), r("p_d").alias("draw"), r("p_a").alias("away")).alias("result"), picked().alias("pick")))
    return df.withColumns({"confidence": sure, "spread": sure - F.least("p_h", "p_d", "p_a"), "playable": (sure >= 0.60) & (league_matches >= 1000), "payload": body})


def summary_line(df: DataFrame) -> Column:
    """What a stored prediction says in one line."""
    pct = lambda c: F.round(c * 100).cast("int").cast("string")
    return F.concat(F.when(picked() == "H", "1").when(picked() == "D", "X").otherwise("2"), F.lit(" "), pct(F.greatest("p_h", "p_d", "p_a")), F.lit("%"))


def league_benchmark(preds: DataFrame, least_gain: float = 0.01) -> DataFrame:
    """Per league the log-loss of the given probabilities, of the overall result rates and of its own rates, and whether its own
    gain ``least_gain`` on the overall ones."""
    shares = lambda by: preds.groupBy(*by).agg(*[F.avg((F.col("result") == x).cast("double")).alias(f"{'g' if not by else 'o'}_{x}") for x in "HDA"])
    made = preds.join(shares(["league"]), "league").crossJoin(F.broadcast(shares([])))
    of = lambda tag: F.when(F.col("result") == "H", F.col(f"{tag}_H")).when(F.col("result") == "D", F.col(f"{tag}_D")).otherwise(F.col(f"{tag}_A"))
    model = F.when(F.col("result") == "H", F.col("p_h")).when(F.col("result") == "D", F.col("p_d")).otherwise(F.col("p_a"))
    loss = lambda c: F.avg(-F.ln(F.greatest(c, F.lit(EPS))))
    per = made.groupBy("league").agg(F.count("*").alias("n"), loss(model).alias("model_ll"), loss(of("g")).alias("global_ll"), loss(of("o")).alias("league_ll"))
    return per.withColumn("own_model", F.col("global_ll") - F.col("league_ll") > least_gain)


def team_records(recs: DataFrame) -> DataFrame:
    """Two rows for each record, one for each team."""
    return recs.withColumn("side", F.explode(F.array(F.struct(F.col("home_team_id").alias("team"), F.lit(1).alias("is_home")), F.struct(F.col("away_team_id").alias("team"), F.lit(0).alias("is_home"))))).select(*recs.columns, "side.*")


def error_trends(recs: DataFrame, n: int = 10) -> DataFrame:
    """Per team: error rate of its last ``n`` records, its change on the ``n`` before them (on the first ``n`` while there are fewer than
    twice as many), and the spread of its running ``n``-record rates; change and spread are 0 below ``n``."""
    rows = team_records(recs).withColumn("wrong", 1 - F.col("correct"))
    forward, back = (W.partitionBy("team").orderBy(*o) for o in ((F.col("date"), F.col("match_id")), (F.desc("date"), F.desc("match_id"))))
    rows = rows.withColumns({"_f": F.row_number().over(forward), "_b": F.row_number().over(back), "_r": F.avg("wrong").over(forward.rowsBetween(1 - n, 0)), "_n": F.count("*").over(W.partitionBy("team"))})
    mean = lambda cond: F.avg(F.when(cond, F.col("wrong")))
    before = F.when(F.max("_n") >= 2 * n, mean(F.col("_b").between(n + 1, 2 * n))).otherwise(mean(F.col("_f") <= n))
    enough = F.max("_n") >= n
    return rows.groupBy("team").agg(F.max("_n").alias("n"), mean(F.col("_b") <= n).alias("recent"), F.when(enough, mean(F.col("_b") <= n) - before).otherwise(0.0).alias("trend"), F.when(enough, F.stddev_pop(F.when(F.col("_f") >= n, F.col("_r")))).otherwise(0.0).alias("volatility"))


def error_features(recs: DataFrame) -> DataFrame:
    """Per team twelve figures less the trends: error rate, mean margin, log-loss, error rate by actual result (0.5 without any), share right
    at home and away, distance of goals from what was expected, and calibration gap."""
    goals = F.col("home_goals") + F.col("away_goals")
    expected = F.when(goals == 0, F.col("p_d")).when(goals == 1, F.when(F.col("home_goals") == 1, F.col("p_h")).otherwise(F.col("p_a"))).otherwise((F.col("p_h") + F.col("p_a")) / 2)
    rows = team_records(recs).withColumns({"wrong": 1 - F.col("correct"), "_g": F.abs(expected - 0.5)})
    rate = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("wrong"))), F.lit(0.5))
    right = lambda side: F.coalesce(1 - F.avg(F.when(F.col("is_home") == side, F.col("wrong"))), F.lit(0.5))
    return rows.groupBy("team").agg(
        F.count("*").alias("n"), F.avg("wrong").alias("error_rate"), F.avg("error_margin").alias("avg_margin"), F.avg("loss").alias("log_loss"),
        *[rate(F.col("result") == x).alias(f"{k}_error_rate") for k, x in (("home", "H"), ("draw", "D"), ("away", "A"))],
        right(1).alias("home_performance"), right(0).alias("away_performance"), F.avg("_g").alias("goal_error"), F.abs(F.avg("confidence") - (1 - F.avg("wrong"))).alias("calibration_gap"),
    )


def league_error_features(recs: DataFrame) -> DataFrame:
    """Per league: error rate, margin, log-loss, and by how much each result is predicted more than it happens."""
    bias = lambda x: F.avg((F.col("predicted") == x).cast("double")) - F.avg((F.col("result") == x).cast("double"))
    return recs.groupBy("league").agg(F.count("*").alias("n"), (1 - F.avg("correct")).alias("error_rate"), F.avg("error_margin").alias("avg_margin"), F.avg("loss").alias("log_loss"), *[bias(x).alias(f"{k}_bias") for k, x in (("home", "H"), ("draw", "D"), ("away", "A"))])


def shrunk(preds: DataFrame, errors: DataFrame) -> DataFrame:
    """``preds`` with doubtful confident predictions drawn in: where 1 less the mean error rate of both teams is below 0.6 and the largest
    probability above 0.7, 30 % of what is above goes to the others in equal parts. Teams without errors count 0.5."""
    side = lambda s: errors.select(F.col("team").alias(f"{s}_team_id"), F.col("error_rate").alias(f"_{s}"))
    made = preds.join(side("home"), "home_team_id", "left").join(side("away"), "away_team_id", "left")
    factor = 1 - (F.coalesce("_home", F.lit(0.5)) + F.coalesce("_away", F.lit(0.5))) / 2
    top = F.greatest("p_h", "p_d", "p_a")
    cut = F.when((factor < 0.6) & (top > 0.7), (top - 0.7) * 0.3).otherwise(0.0)
    others = sum(((F.col(f"p_{x}") != top).cast("int") for x in "hda"), F.lit(0))
    raw = {x: F.when(F.col(f"p_{x}") == top, F.col(f"p_{x}") - cut).otherwise(F.col(f"p_{x}") + cut / F.nullif(others, F.lit(0))) for x in "hda"}
    made = made.withColumns({"confidence_factor": factor, **{f"_n{x}": c for x, c in raw.items()}})
    total = F.col("_nh") + F.col("_nd") + F.col("_na")
    return made.withColumns({f"p_{x}": F.col(f"_n{x}") / total for x in "hda"}).select(*preds.columns, "confidence_factor")


def bias_profiles(recs: DataFrame, n: int = 10) -> DataFrame:
    """Per team and class the mean signed error (happened less probability) of its last ``n`` records, the newer the heavier
    (from 1 / e to 1), within 0.2 of zero."""
    rows = team_records(recs).withColumn("_b", F.row_number().over(W.partitionBy("team").orderBy(F.desc("date"), F.desc("match_id")))).where(F.col("_b") <= n)
    rows = rows.withColumn("_c", F.count("*").over(W.partitionBy("team")))
    weight = F.exp(-F.when(F.col("_c") > 1, (F.col("_b") - 1) / (F.col("_c") - 1)).otherwise(1.0))
    error = lambda x: (F.col("result") == x.upper()).cast("double") - F.col(f"p_{x}")
    mean = lambda x: F.sum(weight * error(x)) / F.sum(weight)
    return rows.groupBy("team").agg(*[F.greatest(F.lit(-0.2), F.least(F.lit(0.2), mean(x))).alias(f"bias_{x}") for x in "hda"])


def unbiased(preds: DataFrame, profiles: DataFrame) -> DataFrame:
    """p_h, p_d, p_a moved by the mean bias of both teams, kept above 0.01, and normalised."""
    side = lambda s: profiles.select(F.col("team").alias(f"{s}_team_id"), *[F.col(f"bias_{x}").alias(f"_{s}_{x}") for x in "hda"])
    made = preds.join(side("home"), "home_team_id", "left").join(side("away"), "away_team_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    made = made.withColumns({f"_n{x}": F.greatest(F.lit(0.01), F.col(f"p_{x}") + (z(f"_home_{x}") + z(f"_away_{x}")) / 2) for x in "hda"})
    total = F.col("_nh") + F.col("_nd") + F.col("_na")
    return made.withColumns({f"p_{x}": F.col(f"_n{x}") / total for x in "hda"}).select(*preds.columns)


def team_corrected(preds: DataFrame, recs: DataFrame, least: int = 5, rate: float = 0.3, cap: float = 0.05) -> DataFrame:
    """p_h, p_d, p_a moved by what teams do at home and away, from ``least`` records on: a favourite that seldom wins there gives up to
    the other two, and a team that often draws raises an unlikely draw. Moves are ``rate`` of the gap, ``cap`` at most; then normalised."""
    per = lambda s: recs.groupBy(f"{s}_team_id").agg(F.count("*").alias(f"_n{s}"), *[F.avg((F.col("result") == x).cast("double")).alias(f"_{s}{x}") for x in "HDA"])
    made = preds.join(per("home"), "home_team_id", "left").join(per("away"), "away_team_id", "left")
    move = lambda cond, gap: F.when(cond, F.least(gap * rate, F.lit(cap))).otherwise(0.0)
    h, d, a = F.col("p_h"), F.col("p_d"), F.col("p_a")
    enough = {s: F.col(f"_n{s}") >= least for s in ("home", "away")}
    win_h = move(enough["home"] & (F.col("_homeH") < 0.30) & (h > 0.45), h - F.col("_homeH"))
    win_a = move(enough["away"] & (F.col("_awayA") < 0.20) & (a > 0.40), a - F.col("_awayA"))
    draws = sum((move(enough[s] & (F.col(f"_{s}D") > 0.40) & (d < 0.25), F.col(f"_{s}D") - d) for s in enough), F.lit(0.0))
    raw = {"h": h - win_h + win_a / 2 - draws / 2, "d": d + win_h / 2 + win_a / 2 + draws, "a": a + win_h / 2 - win_a - draws / 2}
    total = raw["h"] + raw["d"] + raw["a"]
    return made.withColumns({f"_q{x}": raw[x] / total for x in "hda"}).select(*[F.col(f"_q{c[2]}").alias(c) if c in ("p_h", "p_d", "p_a") else F.col(c) for c in preds.columns])


#: From which severity a pattern's kind calls for action, and the improvement to expect for each unit of it.
PLAN = {"league": (0.3, 0.1), "team": (0.4, 0.15), "result": (0.2, 0.08), "goals": (0.3, 0.12), "confidence": (0.3, 0.1), "month": (0.3, 0.08)}


def correction_plan(patterns: DataFrame) -> DataFrame:
    """The action for each pattern (kind, value, severity, rate) that calls for one: leagues that err more often than not are
    weighted down, other leagues recalibrated, other kinds adjusted; and the improvement to expect, an estimate and not a measurement."""
    kind, s = F.col("kind"), F.col("severity")
    table = F.create_map(*[F.lit(x) for k, v in PLAN.items() for x in (k, v[0])]), F.create_map(*[F.lit(x) for k, v in PLAN.items() for x in (k, v[1])])
    action = F.when(kind == "league", F.when(F.col("rate") > 0.5, "downweight").otherwise("recalibrate")).otherwise("adjust")
    return patterns.where(s > table[0][kind]).select("kind", "value", "severity", action.alias("action"), (s * table[1][kind]).alias("expected_gain"))


def adjusted_weights(df: DataFrame, total_severity: Column, weights: list[str]) -> DataFrame:
    """Ensemble weights of a row after a correction: the smallest one (the first on ties) gives up a tenth of the summed severity, 0.3 at
    most and down to 0.05, the others share it; all stay from 0.05 to 1 and are normalised. Below a severity of 0.3 nothing moves."""
    cut = F.when(total_severity >= 0.3, F.least(F.lit(0.3), total_severity * 0.1)).otherwise(0.0)
    low = F.least(*weights)
    first = F.coalesce(*[F.when(F.col(w) == low, i) for i, w in enumerate(weights)])
    raw = {w: F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.when(first == i, F.greatest(F.lit(0.05), F.col(w) - cut)).otherwise(F.col(w) + cut / (len(weights) - 1)))) for i, w in enumerate(weights)}
    made = df.withColumns({f"_{w}": c for w, c in raw.items()})
    total = sum((F.col(f"_{w}") for w in weights), F.lit(0.0))
    moved = {w: F.when(total_severity >= 0.3, F.col(f"_{w}") / total).otherwise(F.col(w)) for w in weights}
    return made.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in df.columns])
