"""Column expressions; all are built-in functions, so they stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Raw fixture status codes and what they mean.
STATUS = {
    "NS": "NS", "TBD": "NS",
    "1H": "LIVE", "HT": "LIVE", "2H": "LIVE", "ET": "LIVE", "BT": "LIVE", "P": "LIVE",
    "FT": "FT", "AET": "FT", "PEN": "FT",
    "SUSP": "SUSP", "INT": "SUSP", "ABD": "ABD", "CANC": "ABD", "PST": "NS", "POST": "POST",
}


def result_label(home: Column, away: Column) -> Column:
    """H, D or A; null when a score is missing."""
    return F.when(home > away, "H").when(home == away, "D").when(home < away, "A")


def points(gf: Column, ga: Column) -> Column:
    """3, 1 or 0 for the side that scored ``gf``."""
    return F.when(gf > ga, 3).when(gf == ga, 1).when(gf < ga, 0)


def safe_odds(odds: Column) -> Column:
    """Decimal odds above 1, else null; text that is no number counts as null."""
    number = odds.try_cast("double")
    return F.when(number > 1, number)


def implied(odds: Column) -> Column:
    """1 / odds for odds above 1, else null."""
    return F.when(odds > 1, 1 / odds)


def margin(*odds: Column) -> Column:
    """The bookmaker's margin: sum of implied probabilities less 1; missing odds add nothing."""
    return sum((F.coalesce(implied(o), F.lit(0.0)) for o in odds), F.lit(0.0)) - 1


def vig_free(odds: Column, *family: Column) -> Column:
    """The implied probability of ``odds`` over the sum of its family's."""
    return implied(odds) / F.nullif(sum((implied(o) for o in family), F.lit(0.0)), F.lit(0.0))


def elo_expected(own: Column, other: Column, edge: Column | float = 50.0) -> Column:
    """Expected score from ratings; ``edge`` is the home side's advantage (negative for the away side)."""
    return 1 / (1 + F.pow(F.lit(10.0), -(own - other + edge) / 400.0))


def decay(days: Column, scale: float = 60.0) -> Column:
    return F.exp(-days / scale)


def season_of(day: Column) -> Column:
    """The season's first year with a cut in July."""
    return F.when(F.month(day) >= 7, F.year(day)).otherwise(F.year(day) - 1)


def season_code(year: Column) -> Column:
    """Two-digit codes of both years: 1993 is 9394."""
    return F.concat(F.lpad((year % 100).cast("string"), 2, "0"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


def status_code(raw: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[raw], F.lit("UNKNOWN"))


def match_type(diff: Column, absolute: bool = True) -> Column:
    """Four bins of the rating difference; ``absolute`` False bins the signed difference."""
    d = F.abs(diff) if absolute else diff
    return F.when(d < 50, "close").when(d < 100, "slight").when(d < 200, "clear").otherwise("strong")


def parse_day(text: Column, clock: Column | None = None) -> Column:
    """dd/MM/yyyy, dd/MM/yy (from 1970 on) or ISO; ``clock`` (HH:mm) is added. Unreadable text is null."""
    four = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(text, F.lit("d/M/yyyy")))
    century = F.when(F.substring(text, -2, 2) >= "70", "19").otherwise("20")
    full = F.concat(F.regexp_replace(text, r"\d{2}$", ""), century, F.substring(text, -2, 2))
    two = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_timestamp(full, F.lit("d/M/yyyy")))
    day = F.coalesce(four, two, F.when(~text.contains("/"), F.try_to_timestamp(text)))
    if clock is None:
        return day
    ok = clock.rlike(r"^\d{1,2}:\d{2}$")
    hours = F.when(ok, F.split(clock, ":")[0].cast("int")).otherwise(0)
    minutes = F.when(ok, F.split(clock, ":")[1].cast("int")).otherwise(0)
    return day + F.make_dt_interval(F.lit(0), hours, minutes)


def no_nan(c: Column) -> Column:
    """NaN as null: a missing statistic must not poison averages."""
    return F.when(~F.isnan(c), c)


def fingerprint(names: Column) -> Column:
    """16 hex digits of the SHA-256 of an array of names in order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(names), ","), 256), 1, 16)


def poisson_pmf(rate: Column, most: int) -> Column:
    """P(0) to P(most) as an array, by the recurrence P(k) = P(k-1) * rate / k."""
    step = lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * rate / k))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.array(F.exp(-rate)), step)


def bound(use: Callable[[Column], Column], **values: Column) -> Column:
    """``use`` of a struct of ``values``, each worked out once a row, also where nested lambdas of ``use`` ask for it again and again."""
    held = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(held, use), F.lit(0))
