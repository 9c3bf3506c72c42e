"""Ratings and probability models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions import bound, elo_expected, poisson_pmf

RATINGS = "match_id long, league int, home_team_id long, away_team_id long, date timestamp_ntz, home_elo double, away_elo double, home_att double, home_def double, away_att double, away_def double"


STATE = "league int, team long, elo double, att double, def double"


@dataclass(frozen=True)
class Elo:
    """How ratings move: ``k`` a match, the home side's ``edge``, what a draw scores, where a team starts. ``winner_edge`` gives the edge to
    the winner instead, and a negative ``edge`` turns it round, as published variants do; ``digits`` rounds new ratings."""

    k: float = 32.0
    edge: float = 50.0
    draw: float = 1 / 3
    first: float = 1500.0
    winner_edge: bool = False
    digits: int | None = None


def _folded(matches: DataFrame, rules: list[Elo], seeds: DataFrame | None, states: bool) -> DataFrame:
    """The fold of each rule and league in (date, match_id) order, from ``seeds`` if given, with the rule's place in the list. The matches are
    read once; Spark sorts rules and leagues (and spills); the fold streams batches and keeps three numbers for each team of one
    league. ``states`` gives the ratings at the end instead of those before each match."""
    schema = "rule int, " + (STATE if states else RATINGS)
    names = [f.split()[0] for f in schema.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rule, rating, attack, defence = None, rules[0], {}, {}, {}
        expect = lambda gap: 1 / (1 + 10 ** (-gap / 400))
        keep = lambda x: x if rule.digits is None else round(x, rule.digits)

        def ended() -> pa.RecordBatch:
            teams = sorted(rating)
            columns = [[key[0]] * len(teams), [key[1]] * len(teams), teams, *[[d.get(t, rule.first) for t in teams] for d in (rating, attack, defence)]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 3), strict=True)], names)

        for batch in batches:
            out, shown = np.empty((batch.num_rows, 6)), np.zeros(batch.num_rows, bool)
            columns = [batch.column(c).to_pylist() for c in ("rule", "league", "kind", "home_team_id", "away_team_id", "home_goals", "away_goals", "r0", "r1", "r2")]
            for i, (number, league, kind, h, a, hg, ag, *seed) in enumerate(zip(*columns, strict=True)):
                if key != (number, league):
                    if states and rating:
                        yield ended()
                    key, rule, rating, attack, defence = (number, league), rules[number], {}, {}, {}
                if kind == 0:
                    rating[h], attack[h], defence[h] = seed
                    continue
                rh, ra = rating.get(h, rule.first), rating.get(a, rule.first)
                ah, dh, aa, da = attack.get(h, rule.first), defence.get(h, rule.first), attack.get(a, rule.first), defence.get(a, rule.first)
                out[i], shown[i] = (rh, ra, ah, dh, aa, da), True
                edge = -rule.edge if rule.winner_edge and ag > hg else rule.edge
                e = expect(rh - ra + edge)
                s, t = (1.0, 0.0) if hg > ag else (rule.draw, rule.draw) if hg == ag else (0.0, 1.0)
                rating[h], rating[a] = keep(rh + rule.k * (s - e)), keep(ra + rule.k * (t - (1 - e)))
                eh, ea = expect(ah - da + rule.edge), expect(aa - dh - rule.edge)
                gh, ga = min(hg / 3, 1.0), min(ag / 3, 1.0)
                attack[h], attack[a] = keep(ah + rule.k * (gh - eh)), keep(aa + rule.k * (ga - ea))
                defence[h], defence[a] = keep(dh - rule.k * (ga - ea)), keep(da - rule.k * (gh - eh))
            if not states:
                made = pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:6]], *[pa.array(c) for c in out.T.copy()]], names)
                yield made.filter(pa.array(shown))
        if states and rating:
            yield ended()

    number = lambda *cs: [F.col(c).cast("double").alias(c) for c in cs]
    ids = [F.col(c).cast("long").alias(c) for c in ("match_id", "home_team_id", "away_team_id")]
    none = lambda *cs: [F.lit(None).cast("double").alias(c) for c in cs]
    known = matches.where("home_goals is not null and away_goals is not null")
    rows = known.select(F.col("league").cast("int").alias("league"), F.lit(1).alias("kind"), F.col("date").cast("timestamp_ntz").alias("date"), *ids, *number("home_goals", "away_goals"), *none("r0", "r1", "r2"))
    if seeds is not None:
        start = seeds.select("league", F.lit(0).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("date"), F.lit(None).cast("long").alias("match_id"), F.col("team").alias("home_team_id"), F.lit(None).cast("long").alias("away_team_id"), *none("home_goals", "away_goals"), F.col("elo").alias("r0"), F.col("att").alias("r1"), F.col("def").alias("r2"))
        rows = rows.union(start)
    rows = rows.withColumn("rule", F.explode(F.array(*[F.lit(k) for k in range(len(rules))])))
    return rows.repartition("rule", "league").sortWithinPartitions("rule", "league", "kind", "date", "match_id").mapInArrow(fold, schema)


def elo_ratings(matches: DataFrame, rule: Elo = Elo(), seeds: DataFrame | None = None) -> DataFrame:
    """Ratings before each match: overall, attack and defence, from ``seeds`` (the ``elo_state`` of earlier matches) if given.

    A rating depends on all earlier matches of both teams, so a league is one fold in (date, match_id) order. Leagues
    fold in parallel. Conceding lowers the defence rating. Matches without a score are left out."""
    return _folded(matches, [rule], seeds, False).drop("rule")


def elo_by_rules(matches: DataFrame, rules: dict[str, Elo]) -> DataFrame:
    """``elo_ratings`` by several rules (named in ``rule``) from one reading of the matches; each rule and league is a fold of its own."""
    made = _folded(matches, list(rules.values()), None, False)
    return made.withColumn("rule", F.element_at(F.array(*[F.lit(k) for k in rules]), F.col("rule") + 1))


def elo_state(matches: DataFrame, rule: Elo = Elo(), seeds: DataFrame | None = None) -> DataFrame:
    """league, team and its ratings after all ``matches``: a snapshot from which later ones go on, so a season's chain need not be run again."""
    return _folded(matches, [rule], seeds, True).drop("rule")


def opponent_strength(ratings: DataFrame, n: int = 10) -> DataFrame:
    """Mean rating of a team's last ``n`` opponents before each match."""
    side = lambda own, opp: F.struct(F.col(f"{own}_team_id").alias("team"), F.col(f"{opp}_elo").alias("opp_elo"))
    long = ratings.select("match_id", "league", "date", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select("match_id", "league", "date", "s.*")
    w = W.partitionBy("league", "team").orderBy("date", "match_id").rowsBetween(-n, -1)
    return long.withColumn("opp_strength", F.avg("opp_elo").over(w))


def elo_1x2(df: DataFrame, draw_rate: float | Column = 0.26, edge: float = 50.0) -> DataFrame:
    """Result probabilities from ratings; the draw shrinks with the rating gap."""
    gap = F.abs(F.col("home_elo") - F.col("away_elo"))
    base = F.greatest(F.lit(0.18), F.least(F.lit(0.34), F.lit(draw_rate) if isinstance(draw_rate, float) else draw_rate))
    d = F.greatest(F.lit(0.05), F.least(F.lit(0.45), base * F.exp(-gap / 350)))
    share = elo_expected(F.col("home_elo"), F.col("away_elo"), edge)
    return df.withColumns({"p_d": d, "p_h": (1 - d) * share, "p_a": (1 - d) * (1 - share)})


def fitted_draw_rate(matches: DataFrame) -> float:
    """The share of draws, which ``elo_1x2`` keeps between 0.18 and 0.34; one number comes to the driver."""
    return matches.agg(F.avg((F.col("home_goals") == F.col("away_goals")).cast("double"))).first()[0] or 0.26


def score_grid(home: Column, away: Column, most: int, rho: float | None = None) -> Column:
    """Score probabilities, not normalised, as an array of (h, a, p), with the low-score correction if ``rho`` is given."""
    tau = lambda h, a: F.when((h == 0) & (a == 0), 1 - home * away * rho).when((h == 0) & (a == 1), 1 + home * rho).when((h == 1) & (a == 0), 1 + away * rho).when((h == 1) & (a == 1), F.lit(1 - rho)).otherwise(1.0)
    ks = F.sequence(F.lit(0), F.lit(most))
    cell = lambda s, h, a: F.struct(h.alias("h"), a.alias("a"), (F.get(s["ph"], h) * F.get(s["pa"], a) * (tau(h, a) if rho is not None else F.lit(1.0))).alias("p"))
    grid = lambda s: F.flatten(F.transform(ks, lambda h: F.transform(ks, lambda a: cell(s, h, a))))
    return bound(grid, ph=poisson_pmf(home, most), pa=poisson_pmf(away, most))


def markets(df: DataFrame, key: str, home: str, away: str, most: int = 10, rho: float | None = None) -> DataFrame:
    """key, 1X2, both-score and over 2.5, all within the row: a home score's share of wins is the running sum of away scores.

    The low-score correction touches four cells, which are added up apart."""
    x, y = F.col(home), F.col(away)
    made = df.select(key, x.alias("_x"), y.alias("_y"), poisson_pmf(x, most).alias("_ph"), poisson_pmf(y, most).alias("_pa"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    step = lambda acc, p: F.struct((acc["below"] + p[1]).alias("below"), (acc["win"] + p[0] * acc["below"]).alias("win"), (acc["draw"] + p[0] * p[1]).alias("draw"))
    pairs = F.zip_with("_ph", "_pa", lambda p, q: F.array(p, q))
    start = F.struct(F.lit(0.0).alias("below"), F.lit(0.0).alias("win"), F.lit(0.0).alias("draw"))
    made = made.select("*", F.aggregate(pairs, start, step).alias("_w"), total("_ph").alias("_th"), total("_pa").alias("_ta"))
    ph, pa = (lambda k: F.get("_ph", F.lit(k))), (lambda k: F.get("_pa", F.lit(k)))
    cell = lambda i, j: ph(i) * pa(j)
    r = F.lit(rho or 0.0)
    more = {(0, 0): -F.col("_x") * F.col("_y") * r * cell(0, 0), (0, 1): F.col("_x") * r * cell(0, 1), (1, 0): F.col("_y") * r * cell(1, 0), (1, 1): -r * cell(1, 1)}
    all_ = F.col("_th") * F.col("_ta") + sum(more.values(), F.lit(0.0))
    win, draw = F.col("_w.win") + more[1, 0], F.col("_w.draw") + more[0, 0] + more[1, 1]
    low = sum((cell(i, j) for i in range(3) for j in range(3 - i)), F.lit(0.0)) + sum(more.values(), F.lit(0.0))
    none = ph(0) * F.col("_ta") + pa(0) * F.col("_th") - cell(0, 0) + more[0, 0] + more[0, 1] + more[1, 0]
    return made.select(key, (win / all_).alias("p_h"), (draw / all_).alias("p_d"), (1 - (win + draw) / all_).alias("p_a"), (1 - none / all_).alias("btts"), (1 - low / all_).alias("over25"))


def top_scores(df: DataFrame, key: str, home: str, away: str, most: int = 10, rho: float | None = None, n: int = 3) -> DataFrame:
    """key and the ``n`` likeliest scores as text; ties go to fewer home goals, then fewer away goals."""
    grid = df.select(key, score_grid(F.col(home), F.col(away), most, rho).alias("_g"))
    ranked = F.slice(F.sort_array(F.transform("_g", lambda c: F.struct((-F.round(c["p"], 12)).alias("p"), c["h"].alias("h"), c["a"].alias("a")))), 1, n)
    return grid.select(key, F.array_join(F.transform(ranked, lambda c: F.concat(c["h"].cast("string"), F.lit("-"), c["a"].cast("string"))), ",").alias("top"))


def closed_form_totals(home: Column, away: Column) -> dict[str, Column]:
    """Overs of one Poisson with the summed rate, and P(both score) of two."""
    return {**total_overs(home + away), "btts": 1 - F.exp(-home) - F.exp(-away) + F.exp(-home - away)}


def total_overs(total: Column, lines: tuple[int, ...] = (1, 2, 3)) -> dict[str, Column]:
    """P(total > line) of one Poisson with the summed rate, in closed form."""
    out = {}
    for line in lines:
        term, below = F.exp(-total), F.lit(0.0)
        for k in range(line + 1):
            below = below + term
            term = term * total / (k + 1)
        out[f"over{line}5"] = 1 - below
    return out


def market_blend(df: DataFrame, alpha: float = 0.35) -> DataFrame:
    """softmax(log book + alpha * log(model / book)) over the three results; book is the vig-free market."""
    total = sum((1 / F.col(f"odds_{x}") for x in "hda"), F.lit(0.0))
    book = {x: 1 / F.col(f"odds_{x}") / total for x in "hda"}
    raw = {x: F.exp(F.ln(book[x]) + alpha * F.ln(F.col(f"p_{x}") / book[x])) for x in "hda"}
    return df.withColumns({f"b_{x}": raw[x] / sum(raw.values(), F.lit(0.0)) for x in "hda"})
