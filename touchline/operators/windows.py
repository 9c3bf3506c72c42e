"""Point-in-time features. Every frame ends before the current row; ``strict`` forms also leave out rows with the same kickoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions import points


def long_view(matches: DataFrame) -> DataFrame:
    """Two rows per match, one for each side, by one pass over the matches."""
    side = lambda own, other, home: F.struct(
        F.col(f"{own}_team_id").alias("team"), F.col(f"{other}_team_id").alias("opp"), F.lit(home).alias("is_home"),
        F.col(f"{own}_goals").alias("gf"), F.col(f"{other}_goals").alias("ga"), F.col(f"{own}_corners").alias("cf"),
    )
    both = matches.select("match_id", "league", "season", "date", F.explode(F.array(side("home", "away", 1), side("away", "home", 0))).alias("s"))
    return both.select("match_id", "league", "season", "date", "s.*").withColumn("pts", points(F.col("gf"), F.col("ga")))


def team(*more: str) -> W:
    """Rows of a team in kickoff order; ties by match_id."""
    return W.partitionBy("league", "team", *more).orderBy("date", "match_id")


def prior(n: int | None, *more: str) -> W:
    return team(*more).rowsBetween(-n if n else W.unboundedPreceding, -1)


def form(long: DataFrame, n: int, columns: tuple[str, ...] = ("gf", "ga", "pts"), by: tuple[str, ...] = (), least: int = 0) -> DataFrame:
    """Means over a team's last ``n`` rows (all earlier ones for n = 0); null below ``least`` rows."""
    w = prior(n, *by)
    tag = "_".join([*by, str(n or "all")])
    value = lambda c: F.when(F.count(c).over(w) >= least, F.avg(c).over(w)) if least else F.avg(c).over(w)
    return long.withColumns({f"{c}_{tag}": value(c) for c in columns})


def strict_form(long: DataFrame, n: int, columns: tuple[str, ...] = ("gf", "ga", "pts")) -> DataFrame:
    """As ``form``, with rows of the same kickoff left out exactly; missing values are skipped.

    A kickoff's first row has only earlier kickoffs before it, so its frame holds for all rows of that kickoff. Both
    windows share one shuffle and one sort."""
    kickoff = W.partitionBy("league", "team", "date").orderBy("match_id")
    made = form(long, n, columns)
    return made.select(*long.columns, *[F.first(f"{c}_{n}").over(kickoff).alias(f"{c}_strict_{n}") for c in columns])


def momentum(long: DataFrame) -> DataFrame:
    """Newest goal difference less the mean of the two before it (null with fewer than three)."""
    gd, w = F.col("gf") - F.col("ga"), team()
    lag = lambda k: F.lag(gd, k).over(w)
    return long.withColumn("momentum", lag(1) - (lag(2) + lag(3)) / 2)


def momentum_reference(long: DataFrame) -> DataFrame:
    """The published order of the same rule: oldest of three less the mean of the newest two."""
    gd, w = F.col("gf") - F.col("ga"), team()
    lag = lambda k: F.lag(gd, k).over(w)
    return long.withColumn("momentum", lag(3) - (lag(1) + lag(2)) / 2)


def recent(long: DataFrame) -> DataFrame:
    """Both-scored and result counts, spread and goal difference of the last five, and rest days."""
    w = prior(5)
    both = ((F.col("gf") > 0) & (F.col("ga") > 0)).cast("int")
    return long.withColumns(
        {
            "btts_5": F.sum(both).over(w),
            "btts_rate_5": F.avg(both).over(w),
            "wins_5": F.sum((F.col("gf") > F.col("ga")).cast("int")).over(w),
            "draws_5": F.sum((F.col("gf") == F.col("ga")).cast("int")).over(w),
            "gf_std_5": F.when(F.count("gf").over(w) >= 3, F.stddev_pop("gf").over(w)),
            "gd_5": F.avg(F.col("gf") - F.col("ga")).over(w),
            "rest_days": seconds_between(F.lag("date").over(team()), F.col("date")) / 86400,
        }
    )


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def weighted_form(long: DataFrame, n: int = 10, scale: float = 60.0, column: str = "gf") -> DataFrame:
    """Mean of the last ``n`` weighted by exp(-days / scale); a list of n pairs per row keeps it exact."""
    w = prior(n)
    items = F.collect_list(F.struct("date", F.col(column).cast("double").alias("v"))).over(w)
    weight = lambda x: F.exp(-seconds_between(x["date"], F.col("date")) / 86400 / scale)
    made = long.withColumn("_items", items)
    total = lambda f: F.aggregate("_items", F.lit(0.0), lambda acc, x: acc + f(x))
    return made.withColumn(f"{column}_decay_{n}", total(lambda x: x["v"] * weight(x)) / F.nullif(total(weight), F.lit(0.0))).drop("_items")


def index_decay_form(long: DataFrame, n: int = 5, column: str = "pts") -> DataFrame:
    """Mean of the last ``n`` with weights exp(-i / 10), i = 0 for the newest."""
    w, weights = team(), [2.718281828459045 ** (-i / 10) for i in range(n)]
    parts = [(F.lag(column, i + 1).over(w), x) for i, x in enumerate(weights)]
    top = sum((F.coalesce(v, F.lit(0)) * x for v, x in parts), F.lit(0.0))
    below = sum((F.when(v.isNotNull(), x).otherwise(0.0) for v, x in parts), F.lit(0.0))
    return long.withColumn(f"{column}_wform_{n}", top / F.nullif(below, F.lit(0.0)))


def head_to_head(matches: DataFrame, n: int = 5) -> DataFrame:
    """Rates over the pair's last ``n`` meetings, seen from this match's home side."""
    h, a = F.col("home_team_id"), F.col("away_team_id")
    w = W.partitionBy("league", "lo", "hi").orderBy("date", "match_id").rowsBetween(-n, -1)
    lo_won = F.when(h == F.col("lo"), F.col("home_goals") > F.col("away_goals")).otherwise(F.col("away_goals") > F.col("home_goals"))
    drawn = F.col("home_goals") == F.col("away_goals")
    made = matches.withColumns({"lo": F.least(h, a), "hi": F.greatest(h, a)})
    made = made.withColumns({"_lo": F.avg(lo_won.cast("int")).over(w), "h2h_draw": F.avg(drawn.cast("int")).over(w), "h2h_goals": F.avg(F.col("home_goals") + F.col("away_goals")).over(w)})
    own = F.when(h == F.col("lo"), F.col("_lo")).otherwise(1 - F.col("_lo") - F.col("h2h_draw"))
    return made.withColumn("h2h_home", own).drop("lo", "hi", "_lo")


def running(df: DataFrame, by: str, values: dict[str, Column]) -> DataFrame:
    """``df`` with _n and _s_<name>: rows of its group before the row in (date, match_id) order, and sums over them.

    Sums per day are run over days, and a day's rows over themselves, so no task sorts a whole group."""
    day = F.to_date("date").alias("_day")
    per = df.groupBy(by, day).agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_s_{k}") for k, v in values.items()])
    past = W.partitionBy(by).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)  # a row for each day
    names = ["_n", *[f"_s_{k}" for k in values]]
    base = per.select(F.col(by).alias("_by"), F.col("_day").alias("_on"), *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"_b{c}") for c in names])
    joined = df.withColumn("_day", day).join(base, F.col(by).eqNullSafe(F.col("_by")) & F.col("_day").eqNullSafe(F.col("_on")))
    own = W.partitionBy(by, "_day").orderBy("date", "match_id").rowsBetween(W.unboundedPreceding, -1)
    within = {"_n": F.count(F.lit(1)).over(own), **{f"_s_{k}": F.coalesce(F.sum(v).over(own), F.lit(0)) for k, v in values.items()}}
    return joined.select(*df.columns, *[(F.col(f"_b{c}") + w).alias(c) for c, w in within.items()])


def league_baseline(matches: DataFrame, window: int | None = None, least: int = 0, with_current: bool = False) -> DataFrame:
    """Running rates of a league over earlier rows; ``window`` limits them, ``with_current`` adds the row itself (as published, it leaks)."""
    h, a = F.col("home_goals"), F.col("away_goals")
    flags = {"lg_home": h > a, "lg_draw": h == a, "lg_goals": h + a, "lg_btts": (h > 0) & (a > 0), "lg_over25": h + a > 2}
    if window is None and not with_current:
        made = running(matches, "league", {k: c.cast("long") for k, c in flags.items()})
        value = lambda k: F.coalesce(F.col(f"_s_{k}") / F.nullif("_n", F.lit(0)), F.lit(None if least else 0.0))
        return made.select(*matches.columns, *[(F.when(F.col("_n") >= least, value(k)) if least else value(k)).alias(k) for k in flags])
    if window is None:
        w = W.partitionBy("league").orderBy("date", "match_id").rowsBetween(W.unboundedPreceding, 0)
        rows = matches
    else:  # a row's number in its league by day sums; runs of rows, each with the window before it, are frames of their own
        size = max(8 * window, 4096)
        numbered = running(matches, "league", {})
        run, at = F.floor(F.col("_n") / size), F.col("_n") % size
        rows = numbered.withColumn("_run", F.explode(F.when(at >= size - window, F.array(run, run + 1)).otherwise(F.array(run))))
        w = W.partitionBy("league", "_run").orderBy("_n").rowsBetween(1 - window if with_current else -window, 0 if with_current else -1)
    rate = lambda c: F.when(F.count("*").over(w) >= least, F.avg(c.cast("double")).over(w)) if least else F.coalesce(F.avg(c.cast("double")).over(w), F.lit(0.0))
    made = rows.withColumns({k: rate(c) for k, c in flags.items()})
    return made if window is None else made.where(F.col("_run") == F.floor(F.col("_n") / size)).drop("_run", "_n")


def streaks(long: DataFrame) -> DataFrame:
    """Per team: longest winning and unbeaten runs, by gaps and islands; ``current_streak`` has the run that goes on."""
    def longest(flag: Column, name: str) -> DataFrame:
        rows = long.withColumn("_f", flag.cast("int")).withColumn("_g", F.sum(1 - F.col("_f")).over(team()))
        return rows.groupBy("league", "team", "_g").agg(F.sum("_f").alias("n")).groupBy("league", "team").agg(F.max("n").alias(name))

    return longest(F.col("gf") > F.col("ga"), "longest_win").join(longest(F.col("gf") >= F.col("ga"), "longest_unbeaten"), ["league", "team"])


def latest(long: DataFrame) -> DataFrame:
    """The newest row of each team."""
    w = W.partitionBy("league", "team").orderBy(F.desc("date"), F.desc("match_id"))
    return long.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def current_streak(long: DataFrame) -> DataFrame:
    """Per team the result (W, D, L) of its newest row and how many rows in a row ended so."""
    mark = F.when(F.col("gf") > F.col("ga"), "W").when(F.col("gf") == F.col("ga"), "D").otherwise("L")
    newest = W.partitionBy("league", "team").orderBy(F.desc("date"), F.desc("match_id"))
    rows = long.withColumn("_m", mark).withColumn("_rn", F.row_number().over(newest)).withColumn("_now", F.first("_m").over(newest))
    rows = rows.groupBy("league", "team").agg(F.first("_now").alias("result"), F.min(F.when(F.col("_m") != F.col("_now"), F.col("_rn"))).alias("_stop"), F.count("*").alias("_all"))
    return rows.select("league", "team", "result", (F.coalesce(F.col("_stop") - 1, "_all")).cast("long").alias("length"))


def current_form(long: DataFrame, n: int = 5, columns: tuple[str, ...] = ("gf", "ga")) -> DataFrame:
    """Means over the last ``n`` rows of a team at its venue, the row itself among them (as published, it knows the match)."""
    w = team("is_home").rowsBetween(1 - n, 0)
    return long.withColumns({f"{c}_now_{n}": F.avg(c).over(w) for c in columns})


def both_sides(matches: DataFrame, long: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``matches`` with home_<c> and away_<c> of its two rows of ``long``: one grouping by match, then one join."""
    of = lambda c, side: F.max(F.when(F.col("is_home") == side, F.col(c)))
    pairs = long.groupBy("match_id").agg(*[of(c, side).alias(f"{name}_{c}") for name, side in (("home", 1), ("away", 0)) for c in columns])
    return matches.join(pairs, "match_id", "left")


def league_factors(matches: DataFrame) -> DataFrame:
    """Strength (goals a match), home advantage, draw rate and goals of a league over its earlier matches; 0 before the first."""
    h, a = F.col("home_goals"), F.col("away_goals")
    made = running(matches, "league", {"h": h.cast("long"), "a": a.cast("long"), "d": (h == a).cast("long")})
    n, s = F.greatest(F.col("_n"), F.lit(1)), {k: F.col(f"_s_{k}") for k in "had"}
    return made.select(*matches.columns, (s["h"] / n + s["a"] / n).alias("lg_strength"), (s["h"] / n - s["a"] / n).alias("lg_home_adv"), (s["d"] / n).alias("lg_draw_rate"), ((s["h"] + s["a"]) / n).alias("lg_total_goals"))


def head_to_head_last20(matches: DataFrame) -> DataFrame:
    """Rates of a pair's last 20 meetings as seen by this match's home side; 0.45, 0.25, 0.30, 2.5 and 0.5 without any."""
    made = head_to_head(matches, 20)
    h, a = F.col("home_team_id"), F.col("away_team_id")
    w = W.partitionBy("league", F.least(h, a), F.greatest(h, a)).orderBy("date", "match_id").rowsBetween(-20, -1)
    both = F.avg(((F.col("home_goals") > 0) & (F.col("away_goals") > 0)).cast("int")).over(w)
    lost = 1 - F.col("h2h_home") - F.col("h2h_draw")
    parts = {"h2h20_home": (F.col("h2h_home"), 0.45), "h2h20_draw": (F.col("h2h_draw"), 0.25), "h2h20_away": (lost, 0.30), "h2h20_goals": (F.col("h2h_goals"), 2.5), "h2h20_btts": (both, 0.5)}
    return made.select(*matches.columns, *[F.coalesce(c, F.lit(d)).alias(k) for k, (c, d) in parts.items()])
