import pytest
from pyspark.sql import functions as F

from fastbreak.plans import context, impact, models, site


def test_season_and_career_tables(spark):
    g = spark.createDataFrame([("a", "T", 2020, 1, 30.0, 20.0, 10.0, 4.0, 3.0, 5.0), ("a", "T", 2020, 2, 20.0, 10.0, 8.0, 0.0, 1.0, 2.0), ("a", "T", 2020, 3, 10.0, 5.0, 4.0, 0.0, 1.0, 2.0)], "player string, team string, season int, oppId int, minutes double, pts double, fga double, fta double, ast double, trb double")
    ranks = spark.createDataFrame([(2020, 1, 10), (2020, 2, 80)], "season int, teamId int, rank int")
    got = {r["split_id"]: r for r in site.season_table(g, ranks).collect()}
    assert {k: v["g"] for k, v in got.items()} == {"ALL": 3, "VS_TOP50": 1, "VS_TOP100": 2}
    assert got["ALL"]["pts_40"] == pytest.approx(40 * 35 / 60)
    assert site.career_table(site.season_table(g, ranks)).first()["pts"] == 35


def test_overlay(spark):
    d = spark.createDataFrame([("A", "x", 5.0), ("B", "y", 3.0), ("C", "z", 9.0)], "player string, team string, v double")
    shown = spark.createDataFrame([("a ", "X", 1, 8.0), ("b", "", 2, 8.0), ("q", "w", 3, 1.0)], "player string, team string, pos int, v double")
    added = site.overlay_rows(d, shown)
    assert [r["player"] for r in added.collect()] == ["C"]
    assert [r["player"].strip() for r in site.insert_sorted(shown, added, "v", [F.col("player")]).collect()] == ["C", "a", "b", "q"]


def test_compare(spark):
    s = spark.createDataFrame([("a", 2020, 1.0), ("b", 2020, 3.0), ("c", 2020, 2.0), ("a", 2021, 5.0), ("c", 2021, 1.0)], "player string, season int, x double")
    got = {r["label"]: r for r in site.compare(s, "a", "b", ["x"]).collect()}
    assert got["Y1"]["edge"] == pytest.approx(-2.0) and got["Y2"]["z_b"] is None


def test_context_and_unified(spark):
    s = spark.createDataFrame([(1, 2020, None, 2.0, 300.0), (1, 2021, 4.0, 1.0, 300.0), (2, 2020, None, None, 10.0)], "athlete_id int, season int, api double, hist double, poss double")
    got = {(r["athlete_id"], r["season"]): r for r in context.pathway_context(s, ["api", "hist"], {"poss": 1.0}).collect()}
    assert got[1, 2020]["impact_source"] == "hist" and got[1, 2021]["velocity"] is not None and got[2, 2020]["flag_no_impact"] == 1
    base, t = s.select("athlete_id", "season"), spark.createDataFrame([(1, 9.0)], "athlete_id int, y double")
    f = {"imp": s.select("athlete_id", "season", "api")}
    on = ["athlete_id", "season"]
    assert context.unified(base, f, on, t).count() == 2
    assert context.unified(base, f, on, t, "joint").where("y_mask = 0").count() == 1
    assert "y" not in context.unified(base, f, on, t, "foundation").columns
    with pytest.raises(ValueError):
        context.unified(base, {"bad": s.withColumn("y", F.lit(1))}, on, t, forbidden={"y"})


def test_enhanced(spark):
    cols = "rim_made, rim_att, three_made, three_att, ft_made, ft_att, mid_made, mid_att, assisted_made".split(", ")
    rows = [(2020, 1, "ALL", 12, 20, 5, 15, 8, 10, 3, 9, 4), (2020, 1, "HIGH", 9, 10, 1, 2, 0, 0, 0, 1, 0)]
    r = context.enhanced_features(spark.createDataFrame(rows, ["season", "athlete_id", "leverage", *cols])).first()
    assert r["clutch_rim_gain"] == pytest.approx(0.3) and r["three_shrunk"] == pytest.approx(7 / 19) and r["garbage_share"] == 0


def test_models(spark):
    import random

    rng = random.Random(0)
    rows = [("rim" if i % 2 else "three", float(i % 7), rng.random() < (0.7 if i % 2 else 0.3), 2 if i % 2 else 3) for i in range(400)]
    _, s = models.expected_points(spark.createDataFrame(rows, "kind string, d double, made boolean, value int"), ["kind"], ["d"])
    m = {r["kind"]: r["x"] for r in s.groupBy("kind").agg(F.avg("xpts").alias("x")).collect()}
    assert 1.2 < m["rim"] < 1.6 and 0.7 < m["three"] < 1.1
    p = spark.createDataFrame([(i, float(i % 2 * 10), 1.0 * (i % 3)) for i in range(30)], "id int, a double, b double")
    assert models.archetypes(p, ["a", "b"], 2)[1].count() == 2


def test_rapm_variants(spark):
    rows = [(2020, "g", k, 0.0 + 30 * k, ["a", "b"] if k % 2 else ["a", "c"], ["x", "y"] if k % 3 else ["x", "z"], 0.0, float(k % 4), 0.0, 1.0, 10.0, 30.0, k % 5) for k in range(60)]
    s = spark.createDataFrame(rows, "season int, gameId string, stint int, t0 double, home array<string>, away array<string>, h0 double, h1 double, a0 double, a1 double, poss double, duration double, margin_start int")
    got = impact.rapm_variants(s, ["plain", "leverage", "high", "clean", "rubber"], 10.0)
    assert got.count() == 6 and len(got.columns) == 7
    o = impact.on_off_from_totals(spark.createDataFrame([(110.0, 100.0, 104.0, 200.0)], "on_rating double, on_time double, team_rating double, team_time double")).first()
    assert o["off_rating"] == pytest.approx(98.0)
