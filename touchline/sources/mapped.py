"""Other providers' files and tables brought to the canonical columns, and their merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from touchline.functions import parse_day, result_label

#: Columns of the wide file and their canonical names.
WIDE = {
    "HomeTeam": "home_team", "AwayTeam": "away_team", "FTHome": "home_goals", "FTAway": "away_goals", "HTHome": "ht_home_goals", "HTAway": "ht_away_goals", "HomeShots": "home_shots", "AwayShots": "away_shots", "HomeTarget": "home_sot", "AwayTarget": "away_sot",
    "HomeCorners": "home_corners", "AwayCorners": "away_corners", "HomeFouls": "home_fouls", "AwayFouls": "away_fouls", "HomeYellow": "home_yellow", "AwayYellow": "away_yellow", "HomeRed": "home_red", "AwayRed": "away_red",
    "OddHome": "b365_home_odds", "OddDraw": "b365_draw_odds", "OddAway": "b365_away_odds", "MaxOver25": "avg_over25_odds", "MaxUnder25": "avg_under25_odds",
}
XG_JSON = "id string, isResult boolean, h struct<id: string, title: string>, a struct<id: string, title: string>, goals struct<h: string, a: string>, xG struct<h: string, a: string>, datetime string"
TEAM_JSON = "date string, home string, away string, score string, stats map<string, map<string, map<string, string>>>"
FIXTURE = "fixture struct<id: long, date: string, status: struct<short: string, elapsed: int>, venue: struct<name: string, city: string>, referee: string>, league struct<id: long, name: string, country: string, season: int, round: string>, teams struct<home: struct<id: long, name: string>, away: struct<id: long, name: string>>, goals struct<home: int, away: int>, score struct<halftime: struct<home: int, away: int>, fulltime: struct<home: int, away: int>>"


def number(text: Column) -> Column:
    """A number of a cell: 59 of "59%", 33 of "33/65 (50%)", itself of plain digits; null of anything else."""
    return F.regexp_extract(F.trim(text), r"^(-?\d+(?:\.\d+)?)(?:%|/.*)?$", 1).try_cast("double")


def score_part(text: Column, k: int) -> Column:
    """Goals of side ``k`` (0 home, 1 away) of "2 - 1", with any dash."""
    return F.get(F.split(text, r"\s*[-–—]\s*"), F.lit(k)).try_cast("int")


def wide_matches(raw: DataFrame) -> DataFrame:
    """A wide file of all leagues (string columns): canonical names, average odds from the bookmaker's where there are none, one row for
    each date and pair (the one with most odds)."""
    kind = lambda c: "string" if "team" in c else ("double" if "odds" in c else "double")
    cell = lambda src, c: F.trim(F.col(src)).try_cast(kind(c)) if src in raw.columns else F.lit(None).cast(kind(c))
    made = raw.select(F.try_to_timestamp("MatchDate").alias("date"), F.concat(F.lit("XG_"), "Division").alias("league"), *[cell(s, c).alias(c) for s, c in WIDE.items()])
    made = made.dropna(subset=["date", "home_team", "away_team", "home_goals", "away_goals"])
    whole = [c for c in WIDE.values() if "odds" not in c and "team" not in c]
    made = made.withColumns({**{c: F.col(c).cast("int") for c in whole}, **{f"avg_{s}_odds": F.col(f"b365_{s}_odds") for s in ("home", "draw", "away")}, "season": F.year("date").cast("string"), "result": result_label(F.col("home_goals"), F.col("away_goals"))})
    filled = sum((F.col(c).isNotNull().cast("int") for c in made.columns), F.lit(0))
    best = F.max_by(F.struct(*made.columns), F.struct(filled, F.to_json(F.struct(*made.columns)))).alias("r")
    return made.groupBy("date", "home_team", "away_team").agg(best).select("r.*")


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    return wide_matches(spark.read.option("header", True).csv(path))


def read_xg(spark: SparkSession, path: str) -> DataFrame:
    """Nested expected-goals JSON: finished matches only."""
    raw = spark.read.schema(XG_JSON).option("multiLine", True).json(path).where("isResult")
    goals, xg = (lambda s: F.col(f"goals.{s}").try_cast("int")), (lambda s: F.col(f"xG.{s}").try_cast("double"))
    return raw.select("id", F.try_to_timestamp("datetime").alias("date"), F.col("h.title").alias("home_team"), F.col("a.title").alias("away_team"), goals("h").alias("home_goals"), goals("a").alias("away_goals"), xg("h").alias("home_xg"), xg("a").alias("away_xg"))


def event_matches(raw: DataFrame) -> DataFrame:
    """Match lists of event data (nested names) to canonical columns; unfinished matches go."""
    made = raw.select(F.col("match_id").cast("long").alias("match_id"), F.to_date("match_date").alias("date"), F.col("home_team.home_team_name").alias("home_team"), F.col("away_team.away_team_name").alias("away_team"), F.col("home_score").cast("int").alias("home_goals"), F.col("away_score").cast("int").alias("away_goals"), F.col("competition.competition_name").alias("league_name"), F.col("season.season_name").alias("season"))
    return made.dropna(subset=["home_goals", "away_goals"])


def venue_rows(rows: DataFrame) -> DataFrame:
    """Two rows a match (match_id, venue Home or Away, team, score, shots, sot, xg) to one, by conditional aggregation."""
    of = lambda c, v: F.max(F.when(F.col("venue") == v, F.col(c)))
    made = rows.groupBy("match_id").agg(*[of(c, v).alias(f"{v.lower()}_{c}") for c in ("team", "shots", "sot", "xg") for v in ("Home", "Away")], F.max("score").alias("_s"))
    return made.withColumns({"home_goals": score_part(F.col("_s"), 0), "away_goals": score_part(F.col("_s"), 1)}).drop("_s")


def leagues_of(leagues: DataFrame, countries: list[str], pattern: str) -> DataFrame:
    """Leagues of the countries, or whose name fits the pattern (any case)."""
    return leagues.where(F.col("country").isin(*countries) | F.col("name").rlike(f"(?i){pattern}"))


def event_list_rows(raw: DataFrame, league_id: int, season: int) -> DataFrame:
    """A league's list of past events to canonical columns; other sports go, scores that are no numbers are null."""
    soccer = raw.where(F.col("strSport") == "Soccer")
    return soccer.select(F.col("dateEvent").try_cast("date").alias("date"), F.col("strHomeTeam").alias("home_team"), F.col("strAwayTeam").alias("away_team"), F.col("intHomeScore").try_cast("int").alias("home_goals"), F.col("intAwayScore").try_cast("int").alias("away_goals"), F.lit(league_id).cast("long").alias("league_id"), F.col("strLeague").alias("league_name"), F.lit(season).alias("season"), F.col("strRound").alias("round"), F.col("strVenue").alias("venue"), F.col("strReferee").alias("referee"))


def fetched(matches: DataFrame, since: str | None = None, limit: int | None = None, played: bool = True) -> DataFrame:
    """Played matches, from a day on, the newest ``limit`` of them in order of time."""
    made = matches.where("home_goals is not null and away_goals is not null") if played else matches
    made = made.where(F.col("date") >= F.lit(since).cast("timestamp_ntz")) if since else made
    return made.orderBy(F.desc("date"), F.desc("match_id")).limit(limit).orderBy("date", "match_id") if limit else made


def team_file_stats(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Deep team files (side, category, statistic, value) to one row a match; ``names`` maps statistics to column names. Cells may be per
    cents or fractions. Statistics are named in any category; the larger value counts where two hold one."""
    raw = spark.read.schema(TEAM_JSON).option("multiLine", True).json(path)
    flat = raw.select("date", "home", "away", "score", F.explode("stats").alias("side", "groups")).select("*", F.explode("groups").alias("group", "cells")).select("date", "home", "away", "score", "side", F.explode("cells").alias("stat", "value"))
    of = lambda stat, side: F.max(F.when((F.col("stat") == stat) & (F.col("side") == F.col(side)), number(F.col("value"))))
    made = flat.groupBy("date", "home", "away", "score").agg(*[of(s, side).alias(f"{side}_{c}") for s, c in names.items() for side in ("home", "away")])
    return made.select(parse_day(F.col("date")).alias("date"), F.col("home").alias("home_team"), F.col("away").alias("away_team"), score_part(F.col("score"), 0).alias("home_goals"), score_part(F.col("score"), 1).alias("away_goals"), *[f"{side}_{c}" for c in names.values() for side in ("home", "away")])


def cached_stats(blobs: DataFrame, names: dict[str, str]) -> DataFrame:
    """A cache of JSON texts (match_id, blob: statistic to "home - away") as columns of both sides."""
    parsed = blobs.select("match_id", F.from_json("blob", "map<string, string>").alias("m"))
    side = lambda stat, k: number(F.get(F.split(F.col("m")[stat], r"\s+-\s+"), F.lit(k)))
    return parsed.select("match_id", *[side(s, k).alias(f"{n}_{c}") for s, c in names.items() for k, n in enumerate(("home", "away"))])


def coalesced(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key; each cell is the first that is not null in the given order."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in rows.columns if c not in keys and c not in order])


def outcome_prices(prices: DataFrame, outcomes: dict[str, str]) -> DataFrame:
    """Per event and market the mean and best price of each outcome (name to column) over bookmakers."""
    of = lambda f, o: f(F.when(F.col("outcome") == o, F.col("price")))
    return prices.groupBy("id", "market").agg(F.countDistinct("bookmaker").alias("bookmakers"), *[of(f, o).alias(f"{n}_{c}") for o, c in outcomes.items() for n, f in (("avg", F.avg), ("best", F.max))])


def master(frames: dict[str, DataFrame], first_year: int = 2000) -> DataFrame:
    """Sources merged in order: times to UTC without zone, text teams, result and total filled, one row for each pair and time (the first
    source's), from ``first_year`` on, only with scores."""
    def shaped(name: str, place: int, df: DataFrame) -> DataFrame:
        at = F.col("date") if dict(df.dtypes)["date"].startswith("timestamp") else F.try_to_timestamp(F.col("date").cast("string"))
        goals = {c: F.col(c).try_cast("double") for c in ("home_goals", "away_goals")}
        made = df.withColumns({"date": F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone()).cast("timestamp_ntz"), **goals, "home_team": F.trim(F.col("home_team").cast("string")), "away_team": F.trim(F.col("away_team").cast("string")), "source": F.lit(name), "_place": F.lit(place)})
        result = result_label(F.col("home_goals"), F.col("away_goals"))
        return made.withColumns({"result": F.coalesce("result", result) if "result" in df.columns else result, "total_goals": F.col("home_goals") + F.col("away_goals")})

    made = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [shaped(n, k, df) for k, (n, df) in enumerate(frames.items())])
    made = made.where((F.year("date") >= first_year) & F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull())
    rest = [c for c in made.columns if c not in ("date", "home_team", "away_team", "_place")]
    first = F.min_by(F.struct(*rest), F.struct("_place", F.to_json(F.struct(*rest)))).alias("r")
    return made.groupBy("date", "home_team", "away_team").agg(first).select("date", "home_team", "away_team", "r.*")


def fixture_rows(raw: DataFrame) -> DataFrame:
    """Nested fixtures (FIXTURE) to flat rows with the status code, and ``issues``: what makes a row bad. A kickoff that is no time is one."""
    from touchline.functions import status_code

    at = F.try_to_timestamp("fixture.date")
    hg, ag, hh, ha = (F.col(c) for c in ("goals.home", "goals.away", "score.halftime.home", "score.halftime.away"))
    rule = lambda name, cond: F.when(cond, F.lit(name))
    rules = F.array(
        rule("same_team", F.col("teams.home.id") == F.col("teams.away.id")), rule("missing_kickoff", F.col("fixture.date").isNull()), rule("bad_kickoff", F.col("fixture.date").isNotNull() & at.isNull()),
        rule("negative_goals", (hg < 0) | (ag < 0)), rule("impossible_score", (hh > hg) | (ha > ag)),
    )
    made = raw.select(F.col("fixture.id").alias("fixture_id"), at.alias("kickoff"), status_code(F.col("fixture.status.short")).alias("status"), F.col("league.id").alias("league_id"), F.col("league.season").alias("season"), F.col("teams.home.id").alias("home_team_id"), F.col("teams.away.id").alias("away_team_id"), F.col("teams.home.name").alias("home_team"), F.col("teams.away.name").alias("away_team"), hg.alias("home_goals"), ag.alias("away_goals"), hh.alias("ht_home_goals"), ha.alias("ht_away_goals"), F.col("fixture.venue.name").alias("venue"), F.col("fixture.referee").alias("referee"), F.filter(rules, lambda x: x.isNotNull()).alias("issues"))
    return made.withColumn("ok", F.size("issues") == 0)


class JsonLinesReader(DataSourceReader):
    """One partition for each season of a provider's folder, in any file system that pyarrow reaches; a season without a file is an error."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.options["seasons"].split(",")]

    def read(self, partition: InputPartition):
        import json

        from pyarrow import fs

        root = self.options["path"].rstrip("/")
        system, path = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        with system.open_input_stream(f"{path}/{partition.value}.json") as file:
            left = b""
            while chunk := file.read(1 << 20):
                *lines, left = (left + chunk).split(b"\n")
                yield from self._rows(lines, partition, json.loads)
            yield from self._rows([left], partition, json.loads)

    @staticmethod
    def _rows(lines: list[bytes], partition: InputPartition, parse):
        for r in (parse(line) for line in lines if line.strip()):
            yield int(partition.value), int(r["id"]), r["home"], r["away"], r.get("home_goals"), r.get("away_goals")


class ProviderSource(DataSource):
    """The contract of a provider as a data source: ``spark.read.format("provider")`` with a folder and seasons; matches come out. Another
    provider is another reader with the same schema."""

    @classmethod
    def name(cls) -> str:
        return "provider"

    def schema(self) -> str:
        return "season int, id long, home_team string, away_team string, home_goals int, away_goals int"

    def reader(self, schema) -> DataSourceReader:
        return JsonLinesReader(self.options)
