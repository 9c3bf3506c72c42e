"""A provider's nine methods over what was fetched from it: JSON lines in a shared folder, read by Spark, as flat tables.

Another provider is another class with the same methods. Teams, fixtures and standings lie in folders ``of_league=`` and ``of_season=``, which a
request prunes; an entity without a folder is an error, a league or season without one has no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import safe_odds
from touchline.sources.mapped import FIXTURE, fixture_rows, leagues_of, number

PLAYER = "player struct<id: long, name: string, number: int, pos: string>"
#: What the provider's answers hold.
SCHEMAS = {
    "leagues": "league struct<id: long, name: string, type: string>, country struct<name: string, code: string>, seasons array<struct<year: int, start: date, end: date>>",
    "teams": "team struct<id: long, name: string, code: string, country: string, founded: int>, venue struct<id: long, name: string, city: string, capacity: int>",
    "fixtures": FIXTURE,
    "standings": "league struct<id: long, season: int, standings: array<array<struct<rank: int, team: struct<id: long, name: string>, points: int, goalsDiff: int, form: string, all: struct<played: int, win: int, draw: int, lose: int, goals: struct<for: int, against: int>>>>>>",
    "statistics": "fixture long, team struct<id: long, name: string>, statistics array<struct<type: string, value: string>>",
    "odds": "fixture struct<id: long>, update string, bookmakers array<struct<id: long, name: string, bets: array<struct<id: long, name: string, values: array<struct<value: string, odd: string>>>>>>",
    "lineups": f"fixture long, team struct<id: long, name: string>, formation string, startXI array<struct<{PLAYER}>>, substitutes array<struct<{PLAYER}>>",
    "injuries": "fixture struct<id: long>, team struct<id: long, name: string>, player struct<id: long, name: string, type: string, reason: string>",
}
#: Names of the statistics that have a column.
STATISTICS = {"Total Shots": "shots", "Shots on Goal": "sot", "Corner Kicks": "corners", "Fouls": "fouls", "Yellow Cards": "yellow", "Red Cards": "red", "Ball Possession": "possession", "expected_goals": "xg"}


class StoredProvider:
    """Leagues, seasons, teams, fixtures, standings, statistics, odds, lineups and injuries under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _raw(self, entity: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[entity]).json(f"{self.root}/{entity}")

    def _of(self, entity: str, league: int, season: int) -> DataFrame:
        made = self.spark.read.schema(SCHEMAS[entity] + ", of_league int, of_season int").json(f"{self.root}/{entity}")
        return made.where((F.col("of_league") == league) & (F.col("of_season") == season)).drop("of_league", "of_season")

    def leagues(self, countries: list[str] | None = None, pattern: str | None = None) -> DataFrame:
        """league_id, name, type, country, code; of the countries, or whose name fits the pattern, if given."""
        made = self._raw("leagues").select(F.col("league.id").alias("league_id"), F.col("league.name").alias("name"), F.col("league.type").alias("type"), F.col("country.name").alias("country"), F.col("country.code").alias("code"))
        return leagues_of(made, countries or [], pattern or "$^") if countries or pattern else made

    def seasons(self, league: int) -> DataFrame:
        """league_id, year, start, end of a league's seasons."""
        return self._raw("leagues").where(F.col("league.id") == league).select(F.col("league.id").alias("league_id"), F.inline("seasons"))

    def teams(self, league: int, season: int) -> DataFrame:
        """team_id, name, code, country, founded, venue_id, venue, city, capacity."""
        t, v = (lambda c: F.col(f"team.{c}")), (lambda c: F.col(f"venue.{c}"))
        return self._of("teams", league, season).select(t("id").alias("team_id"), t("name").alias("name"), t("code").alias("code"), t("country").alias("country"), t("founded").alias("founded"), v("id").alias("venue_id"), v("name").alias("venue"), v("city").alias("city"), v("capacity").alias("capacity"))

    def fixtures(self, league: int, season: int) -> DataFrame:
        """Normalised fixtures with their issues (``fixture_rows``)."""
        return fixture_rows(self._of("fixtures", league, season))

    def standings(self, league: int, season: int) -> DataFrame:
        """A row for each team of each group's table."""
        rows = self._of("standings", league, season).select(F.col("league.id").alias("league_id"), F.col("league.season").alias("season"), F.explode(F.flatten("league.standings")).alias("r"))
        return rows.select("league_id", "season", "r.rank", F.col("r.team.id").alias("team_id"), F.col("r.team.name").alias("team"), "r.points", F.col("r.goalsDiff").alias("goal_difference"), "r.form", *[F.col(f"r.all.{c}").alias(c) for c in ("played", "win", "draw", "lose")], F.col("r.all.goals.for").alias("goals_for"), F.col("r.all.goals.against").alias("goals_against"))

    def statistics(self, fixture: int) -> DataFrame:
        """A row for each team with the named statistics as numbers; percentages lose their sign."""
        named = F.map_from_entries(F.transform("statistics", lambda s: F.struct(s["type"], s["value"])))
        return self._raw("statistics").where(F.col("fixture") == fixture).select(F.col("fixture").alias("fixture_id"), F.col("team.id").alias("team_id"), *[number(F.try_element_at(named, F.lit(k))).alias(v) for k, v in STATISTICS.items()])

    def odds(self, fixture: int) -> DataFrame:
        """A row for each bookmaker, bet and value; odds that are no number above 1 are null."""
        rows = self._raw("odds").where(F.col("fixture.id") == fixture).select(F.col("fixture.id").alias("fixture_id"), F.col("update").try_cast("timestamp").alias("updated"), F.explode("bookmakers").alias("k"))
        rows = rows.select("fixture_id", "updated", F.col("k.name").alias("bookmaker"), F.explode("k.bets").alias("b")).select("fixture_id", "updated", "bookmaker", F.col("b.name").alias("bet"), F.explode("b.values").alias("v"))
        return rows.select("fixture_id", "updated", "bookmaker", "bet", "v.value", safe_odds(F.col("v.odd")).alias("odd"))

    def lineups(self, fixture: int) -> DataFrame:
        """A row for each player of both squads; ``starts`` tells the first eleven."""
        side = lambda c, starts: F.transform(c, lambda x: F.struct(x["player"].alias("p"), F.lit(starts).alias("starts")))
        rows = self._raw("lineups").where(F.col("fixture") == fixture).select(F.col("fixture").alias("fixture_id"), F.col("team.id").alias("team_id"), "formation", F.inline(F.concat(side("startXI", True), side("substitutes", False))))
        return rows.select("fixture_id", "team_id", "formation", F.col("p.id").alias("player_id"), F.col("p.name").alias("player"), F.col("p.number").alias("number"), F.col("p.pos").alias("position"), "starts")

    def injuries(self, fixture: int) -> DataFrame:
        """A row for each player who is missing or in doubt."""
        return self._raw("injuries").where(F.col("fixture.id") == fixture).select(F.col("fixture.id").alias("fixture_id"), F.col("team.id").alias("team_id"), F.col("player.id").alias("player_id"), F.col("player.name").alias("player"), F.col("player.type").alias("type"), F.col("player.reason").alias("reason"))
