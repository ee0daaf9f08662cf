import numpy as np
import pytest
from pyspark.sql import functions as F

from fastbreak.plans import audits, careers, impact, matching, staging


def test_rapm_matches_dense_solution(spark):
    rng = np.random.default_rng(0)
    players = [f"p{i:02d}" for i in range(24)]
    true = rng.normal(0, 3, 24)
    rows = []
    for k in range(400):
        ids = rng.permutation(24)[:10]
        poss = float(rng.integers(4, 12))
        net = (true[ids[:5]].sum() - true[ids[5:]].sum()) * poss / 100
        rows.append((2020, "g", k, [players[i] for i in ids[:5]], [players[i] for i in ids[5:]], 0.0, float(net), 0.0, 0.0, poss))
    df = spark.createDataFrame(rows, "season int, gameId string, stint int, home array<string>, away array<string>, h0 double, h1 double, a0 double, a1 double, poss double")
    got = {r["player"]: r["rapm"] for r in impact.rapm(df, 10.0, 1e-9).collect()}
    x = np.zeros((len(rows), 24))
    for i, r in enumerate(rows):
        for s, ids in ((1, r[3]), (-1, r[4])):
            for p in ids:
                x[i, players.index(p)] = s
    w, y = np.array([r[9] for r in rows]), np.array([100 * r[6] / r[9] for r in rows])
    y = y - (w @ y) / w.sum()
    beta = np.linalg.solve(x.T @ (w[:, None] * x) + 10 * np.eye(24), x.T @ (w * y))
    assert [got[p] for p in players] == pytest.approx(list(beta), abs=1e-5)
    assert np.corrcoef(beta, true)[0, 1] > 0.95
    scored = df.withColumn("a1", F.lit(0.4) * F.col("poss") / 10)
    split = {r["player"]: r for r in impact.rapm_split(scored, 10.0, 1e-9).collect()}
    for name, made in (("o_rapm", [r[6] for r in rows]), ("d_rapm", [-0.4 * r[9] / 10 for r in rows])):
        y2 = 100 * np.array(made) / w
        y2 = y2 - (w @ y2) / w.sum()
        want = np.linalg.solve(x.T @ (w[:, None] * x) + 10 * np.eye(24), x.T @ (w * y2))
        assert [split[p][name] for p in players] == pytest.approx(list(want), abs=1e-5)
    on = impact.on_off(df)
    assert on.count() == 24
    assert impact.season_gate(df, 10, 10).first()["passes"]


def floor(team_a, team_b):
    return [(p, p, "A") for p in team_a] + [(p, p, "B") for p in team_b]


def test_stints_and_minutes(spark):
    a, b, c = list("abcde"), list("vwxyz"), list("abcdf")
    ev = [("g", 2020, 1, 1, 1200, 0, 0, floor(a, b), "A"), ("g", 2020, 2, 1, 1000, 2, 0, floor(a, b)[::-1], "A"), ("g", 2020, 3, 1, 900, 2, 3, floor(c, b), "A"), ("g", 2020, 4, 2, 1200, 2, 3, floor(c, b), "A"), ("g", 2020, 5, 2, 0, 10, 3, floor(c, b)[:9], "A")]
    df = spark.createDataFrame(ev, "gameId string, season int, seq int, period int, remaining int, homeScore int, awayScore int, onFloor array<struct<id:string,name:string,team:string>>, homeTeam string")
    got = [(r["stint"], r["t0"], r["t1"], r["home"]) for r in impact.stints(df).orderBy("stint").collect()]
    assert got == [(1, 0, 200, a), (2, 300, 300, c), (3, 1200, 1200, c)]
    m = {r["player"]: r["minutes"] for r in impact.minutes_on_floor(df).collect()}
    assert m["e"] == pytest.approx(300 / 60) and m["f"] == pytest.approx((900 + 1200) / 60)


def test_lineups(spark):
    ev = [("g", i, "A", p, d) for i, (p, d) in enumerate([("a", None), ("b", None), ("c", None), ("d", None), ("e", "out"), ("f", "in"), ("f", None)])]
    got = {r["seq"]: r for r in impact.reconstruct_lineups(spark.createDataFrame(ev, "gameId string, seq int, team string, player string, direction string")).collect()}
    assert got[0]["onfloor"] == list("abcde") and got[5]["onfloor"] == list("abcdf") and got[5]["confidence"] == 1.0
    assert all(len(r["onfloor"]) == 5 for r in got.values())


SEASONS = "athlete_id long, season int, teamId long, minutes_total double, rim_made double, rim_att double"


def test_final_season(spark):
    df = spark.createDataFrame([(1, 2024, 10, 100.0, 10.0, 20.0), (1, 2025, 10, 90.0, None, None)], SEASONS)
    r = careers.final_season(df, ["rim_made", "rim_att"], ["teamId"]).first()
    assert (r["season"], r["rim_made"]) == (2025, None)
    df = spark.createDataFrame([(1, 2025, 20, 100.0, 5.0, 10.0), (1, 2025, 21, 300.0, 10.0, 20.0)], SEASONS)
    r = careers.final_season(df, ["rim_made", "rim_att"], ["teamId"]).first()
    assert (r["teamId"], r["rim_made"], r["rim_att"]) == (21, 15.0, 30.0)


def test_panel_and_trajectory(spark):
    df = spark.createDataFrame([(1, y, t, v) for y, t, v in ((2020, 1, 0.50), (2021, 1, 0.52), (2022, 2, 0.58), (2023, 2, 0.62))], "athlete_id long, season int, teamId long, ts double")
    p = careers.panel(df, spark.createDataFrame([(1, 2024)], "athlete_id long, draft_year int")).orderBy("season").collect()
    assert [r["stint_id"] for r in p] == [1, 1, 2, 2] and [r["transfer_flag"] for r in p] == [0, 0, 1, 0] and [r["seasons_in_stint"] for r in p] == [1, 2, 1, 2]
    t = careers.trajectory(careers.panel(df), "ts").first()
    assert t["mean"] == pytest.approx(0.555) and t["final_stint_mean"] == pytest.approx(0.60)
    assert careers.panel(df, spark.createDataFrame([(1, 2022)], "athlete_id long, draft_year int")).count() == 2
    short = careers.trajectory(careers.panel(df.where("season < 2021")), "ts").first()
    assert short["slope"] is None and short["slope_missing"] == 1 and short["accel_missing"] == 1


def test_development_recovers_slopes(spark):
    rng = np.random.default_rng(7)
    true = rng.normal(0, 1, 200)
    minutes = rng.choice([200.0, 2000.0], 200)
    rows = [(i, t, float(true[i] * t + rng.normal(0, 20 / np.sqrt(minutes[i]))), float(minutes[i])) for i in range(200) for t in (1, 2, 3)]
    df = spark.createDataFrame(rows, "athlete_id int, t int, y double, minutes double")
    got = {r["athlete_id"]: r for r in careers.development(df, "y", "minutes").collect()}
    assert np.corrcoef(true, [got[i]["slope"] for i in range(200)])[0, 1] > 0.70
    assert careers.development_shrunk(df, "y", "minutes").count() == 200


def test_exposure_and_rookie(spark):
    df = spark.createDataFrame([(10.0, 16.0, None, None), (10.0, 12.0, None, None), (None, None, 7.0, 5.0), (None,) * 4], "games_played double, backfill_games_played double, hist_games_played_text double, college_games_played double")
    assert [(r["games_final"], r["games_source"]) for r in careers.exposure(df).collect()] == [(16.0, "backfill"), (10.0, "api"), (7.0, "text"), (None, "missing")]
    s = spark.createDataFrame([(1, 2019, 50.0), (1, 2020, 900.0), (2, 2018, 10.0)], "nba_id int, season int, minutes double")
    d = spark.createDataFrame([(2, None), (3, 2010)], "nba_id int, draft_year int")
    assert {r["nba_id"]: r["rookie_season"] for r in careers.rookie_season(s, d).collect()} == {1: 2020, 2: 2018}


def test_breakout_windows_gaps(spark):
    g = spark.createDataFrame([(1, 2020, i, i, float(v), 10.0) for i, v in enumerate([1, 1, 9, 9, 9, 1])], "athlete_id int, season int, game_date int, game_id int, made double, tried double")
    assert careers.breakout(g, "made").first()["timing"] == pytest.approx(4 / 5)
    w = careers.season_windows(g, "made", "tried", 3).first()
    assert w["has_last3"] == 1 and w["rate_last3"] == pytest.approx(19 / 30)
    assert careers.season_windows(g, "made", "tried", 5).first()["rate_prev5"] is None


def test_crosswalk(spark):
    nba = spark.createDataFrame([(1, "Gary Payton II", 2016), (2, "Luka Doncic", 2018)], "nba_id int, player_name string, draft_year_proxy int")
    col = spark.createDataFrame([(10, "Gary Payton", 2016, 500), (11, "Gary Trent", 2018, 500), (12, "Luka Donc", 1990, 5)], "athlete_id int, athlete_name string, final_season int, shot_events int")
    links, _ = matching.crosswalk(nba, col)
    assert [(r["nba_id"], r["athlete_id"], r["tier"]) for r in links.collect()] == [(1, 10, "exact")]
    miss = spark.createDataFrame([(2020, "X", "A. Smith", "5", 77.0)], "season int, team string, name string, jersey string, height double")
    known = spark.createDataFrame([(2020, "X", "Andre Smith", "5", 77.5), (2020, "X", "Bo Lee", "5", 80.0)], "season int, team string, name string, jersey string, height double")
    assert matching.body_rescue(miss, known).first()["match"] == "Andre Smith"
    assert matching.token_rescue(miss, known).first()["match"] == "Andre Smith"


def test_staging(spark):
    plays = spark.sql("""SELECT 'g' AS gameId, 2020 AS season, 1L AS id, 1 AS teamId, 2 AS opponentId, 2 AS period, 100 AS secondsRemaining, 50 AS homeScore, 48 AS awayScore, true AS shootingPlay, true AS scoringPlay, 'JumpShot' AS playType,
      array(named_struct('id', 7, 'name', 'a'), named_struct('id', 8, 'name', 'b')) AS participants,
      named_struct('shooter', named_struct('id', 7, 'name', 'a'), 'made', true, 'range', 'rim', 'assisted', true, 'assistedBy', named_struct('id', 8, 'name', 'b'), 'location', named_struct('x', '52.5', 'y', 'bad')) AS shotInfo""")
    s = staging.shots(plays)
    r = s.first()
    assert r["x"] == 52.5 and r["y"] is None and r["high_leverage"] and not r["garbage"]
    f = staging.split_features(s.withColumns({"leverage": F.lit("HIGH"), "strength": F.lit("TOP50")}))
    assert f.count() == 4 and f.where("leverage = 'ALL' and strength = 'ALL'").first()["rim_fg_pct"] == 1.0
    assert {r["athleteId"]: r["ast"] for r in staging.box_from_events(plays).collect()} == {7: 0, 8: 1}


def test_audits(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0)], "k int, v double")
    assert audits.key_check(df, ["k"]).first()["n_failed"] == 1
    assert not audits.null_gate(df, {"v": 0.1}).first()["passes"]
    assert audits.coverage_gate(spark.range(4).toDF("k"), spark.range(3).toDF("k"), ["k"], 0.7).first()["passes"]
    assert not audits.all_pass(audits.checks(df, {"v": F.col("v") > 0})).first()["passes"]
    fixed = audits.repair_keys(spark.createDataFrame([(1, "a", None, None), (2, "a", 2.0, "x"), (3, "a", 4.0, "x")], "k int, g string, p double, c string"), ["k"], ["p"], ["c"], ["g"])
    assert fixed.where("k = 1").first()[2:] == (3.0, "x")


def test_running_lineups(spark, tmp_path):
    from fastbreak.streaming.sessions import running_lineups, sessions

    schema = "gameId string, team string, seq long, player string, direction string"
    spark.createDataFrame([("g", "A", 1, "a", "in"), ("g", "A", 2, "b", "in"), ("g", "A", 3, "a", "out")], schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    q = running_lineups(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("append").format("memory").queryName("lineups_test").start()
    q.processAllAvailable()
    q.stop()
    assert {r["seq"]: r["floor"] for r in spark.table("lineups_test").collect()} == {1: ["a"], 2: ["a", "b"], 3: ["b"]}
    ev = spark.sql("SELECT 1 AS user_id, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 1, timestamp'2024-01-01 00:05:00' UNION ALL SELECT 1, timestamp'2024-01-01 02:00:00'")
    assert sorted(r["n"] for r in sessions(ev, "30 minutes", "user_id").collect()) == [1, 2]


def test_token_rescue_order_and_uniqueness(spark):
    missing = spark.createDataFrame([(2020, "A", "Juan Carlos Lopez"), (2020, "A", "Bob Stone"), (2020, "B", "Al Li")], "season int, team string, name string")
    known = spark.createDataFrame([(2020, "A", "Carlos Diaz"), (2020, "A", "Pedro Lopez"), (2020, "A", "Rob Stone"), (2020, "A", "Sam Stone"), (2020, "A", "Bob Gray"), (2020, "B", "Al Li")], "season int, team string, name string")
    got = {r["name"]: r["match"] for r in matching.token_rescue(missing, known).collect()}
    assert got == {"Juan Carlos Lopez": "Pedro Lopez", "Bob Stone": "Bob Gray"}


def test_unified_refuses_repeated_keys(spark):
    from fastbreak.plans import context

    base = spark.createDataFrame([(1, 2020), (2, 2020)], "athlete_id int, season int")
    twice = spark.createDataFrame([(1, 2020, 5), (1, 2020, 6)], "athlete_id int, season int, x int")
    assert context.unified(base, {"f": twice.limit(1)}, ["athlete_id", "season"]).count() == 2
    with pytest.raises(Exception, match="repeats a key"):
        context.unified(base, {"f": twice}, ["athlete_id", "season"]).collect()


def test_lineups_from_a_checkpoint(spark):
    """Starters are the named five with the substitutions before it taken back."""
    rows = [
        ("g", 1, "A", "p1", None, None), ("g", 2, "A", "p6", "in", None), ("g", 3, "A", "p5", "out", None),
        ("g", 4, "A", None, None, ["p1", "p2", "p3", "p4", "p6"]), ("g", 5, "A", "p7", "in", None), ("g", 6, "A", "p2", "out", None),
    ]
    got = {r["seq"]: r for r in impact.reconstruct_lineups(spark.createDataFrame(rows, "gameId string, seq int, team string, player string, direction string, lineup array<string>")).collect()}
    assert got[1]["onfloor"] == ["p1", "p2", "p3", "p4", "p5"] and got[1]["confidence"] == 1.0
    assert got[3]["onfloor"] == got[4]["onfloor"] == ["p1", "p2", "p3", "p4", "p6"]
    assert got[6]["onfloor"] == ["p1", "p3", "p4", "p6", "p7"]
