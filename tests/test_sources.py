"""Readers over small generated files."""

import json

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from touchline.sources import mapped, provider, readers


def test_season_files_and_bad_cells(spark, tmp_path):
    (tmp_path / "E0_9394.csv").write_text("﻿Date,HomeTeam,AwayTeam,FTHG,FTAG,HTHG,HS,Referee,B365H,Avg>2.5\n14/08/93,Ann, Bee ,2,1,1,9,R,1.5,1.9\n15/08/1993,Cee,Dee,,0,,,,,\n16/08/93,Ann,Cee,0,0,x,7,,bad,2\n")
    got = sorted(readers.read_csv(spark, str(tmp_path)).collect(), key=lambda r: r.date)
    assert len(got) == 2 and (got[0].league, got[0].season, got[0].away_team, got[0].home_shots, got[0].referee, got[0].b365_home_odds, got[0].avg_over25_odds) == ("E0", "9394", "Bee", 9, "R", 1.5, 1.9)
    assert got[1].ht_home_goals is None and got[1].b365_home_odds is None and got[1].away_shots is None
    readers.write_matches(readers.read_csv(spark, str(tmp_path)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("league = 'E0'").count() == 2


def test_envelopes_and_staging(spark, tmp_path):
    head = "﻿Date,HomeTeam,AwayTeam,FTHG,FTAG,Note,FTHG"
    body = [{"fetched_at": t, "source": "s", "endpoint": "e", "params": {"league": "E0", "season": "9394"}, "response": head + "\r\n" + text} for t, text in (("2", '1,"A, B",C,1,2,"say ""hi""",7\r\n2,short,D,1\r\n3,E,F,0,0,n,8,beyond\r\n\r\n'), ("1", "old,,,,,,"))]
    body.append({"fetched_at": "1", "source": "s", "endpoint": "e", "params": {"league": "XX", "season": "1"}, "response": "Date,Other\n1,2"})
    for k, b in enumerate(body):
        (tmp_path / f"{k}.json").write_text(json.dumps(b))
    newest = readers.read_envelopes(spark, str(tmp_path))
    assert newest.count() == 2
    got = {r.row_index: r.cells for r in readers.staged_rows(newest).collect()}
    assert set(got) == {1, 2, 3} and got[1]["HomeTeam"] == "A, B" and got[1]["Note"] == 'say "hi"' and got[1]["FTHG"] == "1"
    assert got[2]["FTAG"] is None and got[2]["HomeTeam"] == "short" and got[3]["FTHG"] == "0" and len(got[3]) == 6
    have = spark.createDataFrame([("E0_9394", 2)], "source_file string, row_index int")
    assert {r.row_index for r in readers.staged_rows(newest, have).collect()} == {1, 3}


def test_nested_files(spark, tmp_path):
    season = {"name": "S", "matches": [{"date": "2020-01-02", "time": "15:30", "team1": "A", "team2": "B", "score": {"ft": [2, 1], "ht": [1, 0]}}, {"date": "2020-01-03", "team1": "C", "team2": "D", "score": {"ft": [0, 0]}}, {"date": "2020-01-04", "team1": "E", "team2": "F"}]}
    (tmp_path / "n.json").write_text(json.dumps(season))
    got = sorted(readers.read_nested(spark, str(tmp_path / "n.json")).collect(), key=lambda r: r.date)
    assert [(r.home_team, r.home_goals, r.ht_home_goals) for r in got] == [("A", 2, 1), ("C", 0, None)] and got[0].date.hour == 15
    xg = [{"id": "1", "isResult": True, "h": {"title": "A"}, "a": {"title": "B"}, "goals": {"h": "2", "a": "0"}, "xG": {"h": "1.53", "a": "bad"}, "datetime": "2020-01-02 15:00:00"}, {"id": "2", "isResult": False}]
    (tmp_path / "x.json").write_text(json.dumps(xg))
    (r,) = mapped.read_xg(spark, str(tmp_path / "x.json")).collect()
    assert (r.home_team, r.home_goals, r.home_xg, r.away_xg) == ("A", 2, 1.53, None)
    teams = {"date": "2020-01-02", "home": "A", "away": "B", "score": "2 - 1", "stats": {"A": {"Overview": {"Ball possession": "59%", "Passes": "33/65 (50%)"}, "Shots": {"Total shots": "12"}}, "B": {"Overview": {"Ball possession": "41%"}}}}
    (tmp_path / "t.json").write_text(json.dumps(teams))
    (r,) = mapped.team_file_stats(spark, str(tmp_path / "t.json"), {"Ball possession": "poss", "Passes": "passes", "Total shots": "shots"}).collect()
    assert (r.home_goals, r.away_goals, r.home_poss, r.away_poss, r.home_passes, r.home_shots, r.away_shots) == (2, 1, 59.0, 41.0, 33.0, 12.0, None)
    blob = spark.createDataFrame([(1, '{"Shots": "7 - 12", "Possession": "40% - 60%"}'), (2, "broken"), (3, None)], "match_id long, blob string")
    made = {r.match_id: r for r in mapped.cached_stats(blob, {"Shots": "shots", "Possession": "poss"}).collect()}
    assert (made[1].home_shots, made[1].away_poss) == (7.0, 60.0) and made[2].home_shots is None and made[3].home_shots is None


def test_wide_file_with_odds_fallback(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Division,MatchDate,HomeTeam,AwayTeam,FTHome,FTAway,HTHome,HTAway,HomeShots,OddHome,OddDraw,OddAway,MaxOver25\nE0,2020-01-02,A,B,2.0,1,1,0,9,1.5,3.5,6,\nE0,2020-01-02,A,B,2.0,1,,,,,,,\nE0,2020-01-03,C,D,,1,,,,,,,\nE0,no day,C,D,1,1,,,,,,,\n")
    (r,) = mapped.read_wide(spark, str(tmp_path / "w.csv")).collect()
    assert (r.league, r.season, r.home_goals, r.ht_home_goals, r.avg_home_odds, r.b365_away_odds, r.avg_over25_odds, r.result) == ("XG_E0", "2020", 2, 1, 1.5, 6.0, None, "H")


def test_venues_events_leagues(spark):
    rows = [(1, "Home", "A", "2–1", 9, 4, 1.2), (1, "Away", "B", "2–1", 5, 2, 0.7)]
    (r,) = mapped.venue_rows(spark.createDataFrame(rows, "match_id long, venue string, team string, score string, shots int, sot int, xg double")).collect()
    assert (r.home_team, r.away_team, r.home_goals, r.away_goals, r.away_shots, r.home_xg) == ("A", "B", 2, 1, 5, 1.2)
    event = spark.read.schema("match_id long, match_date string, home_team struct<home_team_name: string>, away_team struct<away_team_name: string>, home_score int, away_score int, competition struct<competition_name: string>, season struct<season_name: string>").json(spark.sparkContext.parallelize(['{"match_id":1,"match_date":"2020-01-02","home_team":{"home_team_name":"A"},"away_team":{"away_team_name":"B"},"home_score":1,"away_score":0,"competition":{"competition_name":"L"},"season":{"season_name":"2020"}}', '{"match_id":2,"match_date":"2020-01-02"}']))
    assert [(r.match_id, r.home_team, r.league_name) for r in mapped.event_matches(event).collect()] == [(1, "A", "L")]
    leagues = spark.createDataFrame([("X", "First DIVISION"), ("Y", "Cup"), ("Z", "Serie A")], "country string, name string")
    assert {r.name for r in mapped.leagues_of(leagues, ["Y"], "division|liga").collect()} == {"First DIVISION", "Cup"}


def test_merges(spark):
    rows = [("k", 1, None, 5, "late"), ("k", 0, 3, None, "first"), ("j", 0, None, None, None)]
    got = {r.key: r for r in mapped.coalesced(spark.createDataFrame(rows, "key string, place int, a int, b int, c string"), ["key"], ["place"]).collect()}
    assert (got["k"].a, got["k"].b, got["k"].c) == (3, 5, "first") and got["j"].a is None
    one = spark.createDataFrame([("2020-01-02 15:00:00", "A", "B", "1", "0"), ("1999-01-01", "A", "B", "1", "0"), ("bad", "A", "B", "1", "0")], "date string, home_team string, away_team string, home_goals string, away_goals string")
    two = spark.createDataFrame([("2020-01-02T17:00:00+02:00", " A", "B", 9, 9, 1.5), ("2020-01-03", "C", "D", None, 1, None)], "date string, home_team string, away_team string, home_goals int, away_goals int, home_xg double")
    (r,) = mapped.master({"one": one, "two": two}).collect()
    assert (r.source, r.home_goals, r.result, r.total_goals, r.home_xg) == ("one", 1.0, "H", 1.0, None)
    odds = spark.createDataFrame([(1, [("b1", [("h2h", [("A", 1.5), ("B", 3.0)])]), ("b2", [("h2h", [("A", 1.7), ("B", 2.8)])])])], "id long, bookmakers array<struct<key: string, markets: array<struct<key: string, outcomes: array<struct<name: string, price: double>>>>>>")
    (r,) = mapped.outcome_prices(readers.bookmaker_prices(odds), {"A": "home", "B": "away"}).collect()
    assert (r.bookmakers, r.avg_home, r.best_home, r.best_away) == (2, pytest.approx(1.6), 1.7, 3.0)
    a, b = (spark.createDataFrame([(d,)], "date date") for d in (__import__("datetime").date(2020, 1, 1), __import__("datetime").date(2020, 1, 5)))
    (r,) = readers.freshness(a, b).collect()
    assert r.estimate == 20


def test_fixtures(spark):
    good = '{"fixture":{"id":1,"date":"2024-08-16T19:00:00+00:00","status":{"short":"FT"},"venue":{"name":"V"}},"league":{"id":39,"season":2024},"teams":{"home":{"id":33,"name":"H"},"away":{"id":40,"name":"A"}},"goals":{"home":0,"away":3},"score":{"halftime":{"home":0,"away":2}}}'
    bad = good.replace('"goals":{"home":0', '"goals":{"home":-1').replace('"halftime":{"home":0', '"halftime":{"home":5').replace('"short":"FT"', '"short":"PST"').replace("2024-08-16T19:00:00+00:00", "soon")
    raw = spark.read.schema(mapped.FIXTURE).json(spark.sparkContext.parallelize([good, bad]))
    one, two = sorted(mapped.fixture_rows(raw).collect(), key=lambda r: not r.ok)
    assert (one.home_team_id, one.away_team_id, one.home_goals, one.away_goals, one.ht_away_goals, one.status, one.league_id, one.ok) == (33, 40, 0, 3, 2, "FT", 39, True)
    assert one.kickoff.hour == 19 and two.issues == ["bad_kickoff", "negative_goals", "impossible_score"] and two.status == "NS"


def test_provider_source(spark, tmp_path):
    for season in (2020, 2021):
        (tmp_path / f"{season}.json").write_text("\n".join(json.dumps({"id": season * 10 + k, "home": "A", "away": "B", "home_goals": k}) for k in range(3)))
    spark.dataSource.register(mapped.ProviderSource)
    read = lambda seasons: spark.read.format("provider").option("path", str(tmp_path)).option("seasons", seasons).load()
    got = read("2020,2021")
    assert got.count() == 6 and got.where("season = 2021 and home_goals = 2").first().id == 20212
    with pytest.raises(PySparkException):  # a season without a file must not pass for one without matches
        read("2020,2021,2022").count()


def test_stored_provider(spark, tmp_path):
    def put(entity, *rows, **keys):
        folder = tmp_path.joinpath(entity, *[f"{k}={v}" for k, v in keys.items()])
        folder.mkdir(parents=True)
        (folder / "a.json").write_text("\n".join(json.dumps(r) for r in rows))

    put("leagues", {"league": {"id": 39, "name": "Premier League", "type": "League"}, "country": {"name": "England", "code": "GB"}, "seasons": [{"year": 2021, "start": "2021-08-01", "end": "2022-05-22"}, {"year": 2022, "start": "2022-08-01", "end": None}]}, {"league": {"id": 203, "name": "Süper Lig"}, "country": {"name": "Turkey"}, "seasons": []})
    put("teams", {"team": {"id": 33, "name": "United", "code": "MUN", "country": "England", "founded": 1878}, "venue": {"id": 556, "name": "Old", "capacity": 76000}}, of_league=39, of_season=2021)
    put("fixtures", {"fixture": {"id": 1, "date": "2022-04-19T19:00:00+00:00", "status": {"short": "FT"}}, "league": {"id": 39, "season": 2021}, "teams": {"home": {"id": 33, "name": "United"}, "away": {"id": 40, "name": "City"}}, "goals": {"home": 0, "away": 3}, "score": {"halftime": {"home": 0, "away": 2}}}, of_league=39, of_season=2021)
    put("standings", {"league": {"id": 39, "season": 2021, "standings": [[{"rank": 1, "team": {"id": 40, "name": "City"}, "points": 93, "goalsDiff": 73, "form": "WWW", "all": {"played": 38, "win": 29, "draw": 6, "lose": 3, "goals": {"for": 99, "against": 26}}}]]}}, of_league=39, of_season=2021)
    put("statistics", {"fixture": 1, "team": {"id": 33}, "statistics": [{"type": "Ball Possession", "value": "41%"}, {"type": "Total Shots", "value": 7}, {"type": "Red Cards", "value": None}]})
    put("odds", {"fixture": {"id": 1}, "update": "2022-04-18T10:00:00+00:00", "bookmakers": [{"id": 8, "name": "B", "bets": [{"id": 1, "name": "Match Winner", "values": [{"value": "Home", "odd": "3.10"}, {"value": "Draw", "odd": "x"}]}]}]})
    put("lineups", {"fixture": 1, "team": {"id": 33}, "formation": "4-2-3-1", "startXI": [{"player": {"id": 9, "name": "A", "number": 1, "pos": "G"}}], "substitutes": [{"player": {"id": 10, "name": "B", "number": 12, "pos": "D"}}]})
    put("injuries", {"fixture": {"id": 1}, "team": {"id": 33}, "player": {"id": 11, "name": "C", "type": "Missing Fixture", "reason": "Knee"}})
    p = provider.StoredProvider(spark, str(tmp_path))
    rows = lambda df, *c: sorted(tuple(r) for r in (df.select(*c) if c else df).collect())
    assert rows(p.leagues(), "league_id", "name", "country") == [(39, "Premier League", "England"), (203, "Süper Lig", "Turkey")] and p.leagues(pattern="süper|nothing").count() == 1 and p.leagues(["England"]).count() == 1
    assert [(r[1], str(r[2])) for r in rows(p.seasons(39))] == [(2021, "2021-08-01"), (2022, "2022-08-01")] and p.seasons(203).count() == 0
    assert rows(p.teams(39, 2021), "team_id", "name", "venue_id") == [(33, "United", 556)] and p.teams(39, 2020).count() == 0
    assert rows(p.fixtures(39, 2021), "fixture_id", "home_team_id", "away_goals", "status", "ok") == [(1, 33, 3, "FT", True)]
    assert rows(p.standings(39, 2021), "rank", "team_id", "points", "goals_for") == [(1, 40, 93, 99)]
    assert rows(p.statistics(1), "team_id", "shots", "possession", "red") == [(33, 7.0, 41.0, None)] and p.statistics(2).count() == 0
    assert rows(p.odds(1), "bookmaker", "bet", "value", "odd") == [("B", "Match Winner", "Draw", None), ("B", "Match Winner", "Home", 3.1)]
    assert rows(p.lineups(1), "player_id", "starts", "formation") == [(9, True, "4-2-3-1"), (10, False, "4-2-3-1")] and rows(p.injuries(1), "player_id", "reason") == [(11, "Knee")]
    assert any("PartitionFilters" in line and "39" in line for line in p.fixtures(39, 2021)._jdf.queryExecution().toString().splitlines())
    with pytest.raises(AnalysisException):
        provider.StoredProvider(spark, str(tmp_path / "none")).leagues()


def test_event_lists(spark):
    rows = [("Soccer", "2023-05-01", "A", "B", "2", "1", "L", "30", "V", None), ("Soccer", "bad", "A", "B", None, "x", "L", "31", None, None), ("Darts", "2023-05-01", "A", "B", "1", "0", "L", "1", None, None)]
    raw = spark.createDataFrame(rows, "strSport string, dateEvent string, strHomeTeam string, strAwayTeam string, intHomeScore string, intAwayScore string, strLeague string, strRound string, strVenue string, strReferee string")
    got = sorted((str(r.date), r.home_goals, r.away_goals, r.league_id, r.season) for r in mapped.event_list_rows(raw, 4328, 2022).collect())
    assert got == [("2023-05-01", 2, 1, 4328, 2022), ("None", None, None, 4328, 2022)]


def test_streams(spark, small, tmp_path):
    from touchline.streaming import events as st

    e = spark.read.parquet(f"{small}/events.parquet")
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: st.event_stream(spark, str(tmp_path / "in"), e.schema, 1)
    st.append_snapshots(stream().select("event_id", "value"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    st.append_snapshots(stream().select("event_id", "value"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == e.count() == out.distinct().count()
    q = st.last_snapshots(stream()).writeStream.outputMode("update").format("memory").queryName("last_seen").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    want = {r.user_id: r.event_id for r in e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).collect()}
    rows = spark.table("last_seen").collect()
    seen = {}
    for r in rows:
        seen[r.user_id] = r.event_id  # rows of a user come in the order of its batches
    assert set(seen) == set(want) and sum(seen[k] == want[k] for k in want) == len(want)
