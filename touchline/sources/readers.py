"""Raw files to canonical rows, all by Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions import parse_day, season_code

ENVELOPE = "fetched_at string, source string, endpoint string, params struct<league: string, season: string>, response string"
NESTED = "name string, matches array<struct<date: string, time: string, team1: string, team2: string, score: struct<ft: array<int>, ht: array<int>>>>"
#: Columns of the result files and their canonical names.
COLUMNS = {
    "HomeTeam": "home_team", "AwayTeam": "away_team", "FTHG": "home_goals", "FTAG": "away_goals", "HTHG": "ht_home_goals", "HTAG": "ht_away_goals", "Referee": "referee",
    "HS": "home_shots", "AS": "away_shots", "HST": "home_sot", "AST": "away_sot", "HC": "home_corners", "AC": "away_corners", "HF": "home_fouls", "AF": "away_fouls", "HY": "home_yellow", "AY": "away_yellow", "HR": "home_red", "AR": "away_red",
    "AvgH": "avg_home_odds", "AvgD": "avg_draw_odds", "AvgA": "avg_away_odds", "B365H": "b365_home_odds", "B365D": "b365_draw_odds", "B365A": "b365_away_odds", "Avg>2.5": "avg_over25_odds", "Avg<2.5": "avg_under25_odds",
    "AvgCH": "avg_close_home_odds", "AvgCD": "avg_close_draw_odds", "AvgCA": "avg_close_away_odds", "AvgC>2.5": "avg_close_over25_odds", "AvgC<2.5": "avg_close_under25_odds",
}
REQUIRED = ("Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG")


def canonical_csv(df: DataFrame) -> DataFrame:
    """String columns of a result file to canonical ones; missing columns become null; rows without teams or scores go."""
    names = {c.strip().lstrip("﻿"): c for c in df.columns}
    if lost := [c for c in REQUIRED if c not in names]:
        raise ValueError(f"missing columns: {lost}")
    cell = lambda raw, kind: (F.trim(F.col(f"`{names[raw]}`")).try_cast(kind) if raw in names else F.lit(None).cast(kind))
    kinds = {"home_team": "string", "away_team": "string", "referee": "string"}
    made = df.select(parse_day(F.col(f"`{names['Date']}`")).alias("date"), *[cell(r, kinds.get(c, "double" if "odds" in c else "int")).alias(c) for r, c in COLUMNS.items()], *([F.col("_file")] if "_file" in df.columns else []))
    return made.where("home_team is not null and away_team is not null and home_goals is not null and away_goals is not null")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A folder of season files named league_season.csv."""
    raw = spark.read.option("header", True).csv(path).withColumn("_file", F.col("_metadata.file_name"))
    part = lambda k: F.split(F.regexp_replace("_file", r"\.csv$", ""), "_")[k]
    return canonical_csv(raw).withColumns({"league": part(0), "season": part(1)}).drop("_file")


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """The newest envelope of each source, endpoint and parameters."""
    raw = spark.read.schema(ENVELOPE).option("multiLine", True).json(path)
    w = W.partitionBy("source", "endpoint", "params.league", "params.season").orderBy(F.desc("fetched_at"))
    return raw.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def csv_cells(line: Column) -> Column:
    """The cells of one line of CSV; a cell in double quotes may hold commas, and doubled quotes for one."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), 1)
    plain = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda c: F.when(c.startswith('"') & (F.length(c) > 1), plain(c)).otherwise(c))


def staged_rows(envelopes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """CSV text in envelopes to rows (source_file, row_index, cells by header name), without those that exist.

    Short lines are filled with nulls, cells beyond the header go, and of repeated header names the first counts. Files that
    lack a required column are left out."""
    key = F.concat_ws("_", "params.league", "params.season").alias("source_file")
    lines = envelopes.select(key, F.posexplode(F.split(F.regexp_replace("response", "\ufeff", ""), r"\r?\n")).alias("row_index", "line")).where("trim(line) <> ''")
    head = lines.where("row_index = 0").select("source_file", F.transform(csv_cells(F.col("line")), lambda x: F.trim(x)).alias("names"))
    head = head.where(F.size(F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), "names")) == 0).dropDuplicates(["source_file"])
    found = lines.where("row_index > 0").join(head, "source_file").withColumn("raw", csv_cells(F.col("line")))
    items = F.transform("names", lambda x, i: F.struct(x.alias("key"), F.get("raw", i).alias("value"), (F.array_position("names", x) == i + 1).alias("first")))
    mapped = F.map_from_entries(F.transform(F.filter(items, lambda e: e["first"]), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    made = found.select("source_file", "row_index", mapped.alias("cells")).dropDuplicates(["source_file", "row_index"])
    return made.join(existing, ["source_file", "row_index"], "left_anti") if existing is not None else made


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """Nested season JSON: matches with a full-time pair."""
    made = spark.read.schema(NESTED).option("multiLine", True).json(path).select("name", F.explode("matches").alias("m")).where(F.size("m.score.ft") == 2)
    return made.select("name", parse_day(F.col("m.date"), F.col("m.time")).alias("date"), F.col("m.team1").alias("home_team"), F.col("m.team2").alias("away_team"), F.col("m.score.ft")[0].alias("home_goals"), F.col("m.score.ft")[1].alias("away_goals"), F.get("m.score.ht", F.lit(0)).alias("ht_home_goals"), F.get("m.score.ht", F.lit(1)).alias("ht_away_goals"))


def season_codes(spark: SparkSession, current: int, years: int = 30, first: int = 1993) -> DataFrame:
    made = spark.range(max(first, current - years + 1), current + 1).select(F.col("id").cast("int").alias("year"))
    return made.withColumn("code", season_code(F.col("year")))


def bookmaker_prices(odds: DataFrame) -> DataFrame:
    """Bookmakers, markets and outcomes unnested to one row per price."""
    a = odds.select("id", F.explode("bookmakers").alias("b")).select("id", F.col("b.key").alias("bookmaker"), F.explode("b.markets").alias("m"))
    return a.select("id", "bookmaker", F.col("m.key").alias("market"), F.explode("m.outcomes").alias("o")).select("id", "bookmaker", "market", F.col("o.name").alias("outcome"), F.col("o.price").alias("price"))


def freshness(local: DataFrame, raw: DataFrame) -> DataFrame:
    """Newest day on both sides and the estimated number of new matches (five a day)."""
    a, b = local.agg(F.max("date").alias("local_day")), raw.agg(F.max("date").alias("raw_day"))
    return a.crossJoin(F.broadcast(b)).withColumn("estimate", F.greatest(F.datediff("raw_day", "local_day"), F.lit(0)) * 5)


def write_matches(df: DataFrame, path: str) -> None:
    """Canonical matches by league and season, so readers prune partitions."""
    df.repartition("league", "season").write.partitionBy("league", "season").parquet(path)
