"""Joins whose rows between input and result must not grow with the square of a group."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fastbreak.operators import aggregates as agg
from fastbreak.operators import joins, similar, windows
from fastbreak.plans import matching, ratings


def most_rows(df, metric="numOutputRows"):
    """Most rows that any operator of the plan of `df` puts out (or another of its metrics) when it runs."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        own = p.metrics().get(metric)
        children = p.children()
        return max([own.get().value() if own.isDefined() else 0, *(walk(children.apply(i)) for i in range(children.size()))])

    return walk(plan)


def test_games_by_score_counts_games_of_one_score(spark):
    n = 400
    games = lambda s, home, away: spark.range(n).select(F.col("id").alias(f"{s}_id"), F.lit("d").alias("date"), F.lit(home).alias(f"{s}_home"), F.lit(away).alias(f"{s}_away"), (F.col("id") % 2).alias(f"{s}_hp"), F.lit(1).alias(f"{s}_ap"))
    out = joins.games_by_score(games("l", "a b", "c"), games("r", "c", "b a"))
    assert most_rows(out) <= 4 * n
    assert {(r.l_id % 2, r.r_id, r.method, r.confidence) for r in out.collect()} == {(0, 0, "score_teams", 0.95), (1, 1, "score_teams", 0.95)}
    assert out.count() == n


def test_tiers_meet_counted_values(spark):
    n = 300
    left = spark.range(n).select(F.col("id").alias("k"), F.lit(1).alias("g"))
    out = joins.tiered(left, "k", [("g", spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("v")), ["g"])], "v")
    assert most_rows(out) <= 4 * n
    assert {tuple(r) for r in out.select("v", "tier").distinct().collect()} == {(None, "ambiguous")}


def test_id_then_name_looks_each_name_up_once(spark):
    n = 300
    left = spark.range(n).select(F.col("id").alias("k"), F.lit(None).cast("string").alias("i"), F.lit("a").alias("name"), (F.col("id") % 3).alias("at"))
    right = spark.range(n).select(F.col("id").alias("i"), F.lit("a").alias("name"), (F.col("id") % 2 + 2).alias("yr"), F.col("id").alias("v"))
    out = joins.id_then_name(left, right, "k", "i", "name", "at", "yr", "v")
    assert most_rows(out) <= 4 * n
    assert {(r.k % 3, r.v, r.method) for r in out.collect()} == {(0, 0, "name_year"), (1, 0, "name_year"), (2, 0, "name_year")} and out.count() == n


def test_suffixes_join_on_endings(spark):
    n = 300
    left = spark.range(n).select(F.lit(1).alias("g"), F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("a"))
    right = left.select("g", F.concat(F.lit("é "), "a").alias("b"))
    out = joins.suffix_match(left, right, ["g"], "a", "b")
    assert most_rows(out) <= 10 * n
    assert {(r.a, r.b) for r in out.collect()} == {(r.a, f"é {r.a}") for r in left.collect()}
    few = lambda names, c: spark.createDataFrame([(1, x) for x in names], f"g int, {c} string")
    hits = lambda a, b: sorted((r.a, r.b) for r in joins.suffix_match(few(a, "a"), few(b, "b"), ["g"], "a", "b").collect())
    assert hits(["ab", "b", "", None], ["ab", "xb", "", None]) == []
    assert hits(["ab", ""], ["xab", "ab"]) == [("ab", "xab")] and hits(["", "q", "q"], ["z", "", "zq"]) == []
    assert hits(["", "b"], ["b", ""]) == [("", "b")] and hits(["b", "b"], ["ab"]) == []


def test_fuzzy_of_equal_texts_joins_on_them(spark):
    n = 300
    left = spark.range(n).select(F.lit(1).alias("o"), F.col("id").alias("a"), F.concat(F.lit("n"), "id").alias("x"))
    right = left.select("o", F.col("a").alias("b"), F.col("x").alias("y"))
    out = joins.fuzzy(left, right, ["o"], "x", "y", 1.0, "a", "b")
    assert most_rows(out) <= 2 * n
    assert sorted((r.a, r.b, r.x, r.y, r.score) for r in out.collect()) == [(i, i, f"n{i}", f"n{i}", 1.0) for i in range(n)]


def test_token_rescue_settles_tokens_first(spark):
    n = 300
    name = lambda last: spark.range(n).select(F.lit(1).alias("season"), F.lit(1).alias("team"), F.concat(F.lit(last), "id", F.lit(" same")).alias("name"))
    out = matching.token_rescue(name("one"), name("one"))
    assert most_rows(out) <= 4 * n
    assert {(r.name, r.match) for r in out.collect()} == {(f"one{i} same", f"one{i} same") for i in range(n)}


def test_body_rescue_meets_kinds_of_bodies(spark):
    n = 300
    c = F.col("id")
    side = lambda jersey, height: spark.range(n).select(F.lit(1).alias("season"), F.lit(1).alias("team"), jersey.alias("jersey"), height.alias("height"), F.concat(F.lit("a n"), c).alias("name"))
    out = matching.body_rescue(side(c % 2, F.lit(70.0)), side(F.lit(1), F.lit(70.5) + c % 3))
    assert most_rows(out) <= 4 * n
    want = {(f"a n{i}", f"a n{i}" if i % 3 == 0 else "a n0", 7 if i % 3 == 0 else 6) for i in range(1, n, 2)}
    assert {(r.name, r.match, r.points) for r in out.collect()} == want


def test_value_ranks_are_window_ranks(spark):
    rows = spark.createDataFrame([(g, v) for g in ("a", "b", None) for v in (3, 1, 3, None, 2, 3)], "g string, v int")
    for down in (True, False):
        order = F.desc_nulls_last("v") if down else F.asc_nulls_first("v")
        w = W.partitionBy("g").orderBy(order)
        want = rows.select("g", "v", F.rank().over(w), F.dense_rank().over(w), windows.average_rank(["g"], "v", down) if not down else F.rank().over(w) + (F.count("*").over(W.partitionBy("g", "v")) - 1) / 2).distinct()
        got = windows.value_ranks(rows, ["g"], "v", down)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == 12


def test_window_ranks_query_sorts_values_only(spark):
    from fastbreak import queries
    from tests.helpers import SF

    plan = queries.QUERIES["window_ranks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Aggregate" in plan.split("Window")[-1]


def test_edit_pairs_lose_none_and_stay_few(spark):
    rng = random.Random(5)
    names = {"".join(rng.choice("ab") for _ in range(rng.randrange(0, 14))) for _ in range(60)} | {x + y for x in ("long name of many letters", "c" * 40) for y in ("", "x", "xy", "xyz", "xyzu")} | {"a", "", "ab"}
    df = lambda c: spark.createDataFrame([(1, x) for x in sorted(names)], f"g int, {c} string")
    for least in (0.6, 0.8, 0.92):
        good = (1 - F.levenshtein("_l", "_r") / F.greatest(F.length("_l"), F.length("_r"), F.lit(1))) >= least
        want = {(x._l, x._r) for x in df("_l").join(df("_r"), "g").where(good).collect()}
        got = similar.edit_pairs(df("_l"), df("_r"), ["g"], least)
        assert want <= {(x._l, x._r) for x in got.collect()}


def test_identity_compares_near_names_of_a_team(spark):
    n = 600
    ids = spark.range(n)
    name = F.concat(F.lit("someone "), F.lpad((F.col("id") * 7919 % 100003).cast("string"), 6, "0"), F.lpad((F.col("id") * 104729 % 99991).cast("string"), 6, "0"))
    side = lambda key, who: ids.select(F.col("id").alias(key), who.alias("name"), F.lit(1).alias("team_id"), F.lit(1).alias("season"))
    like = lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    out = matching.resolve_identity(side("key", F.concat(name, F.lit("x"))).withColumn("player_id", F.lit(None).cast("string")), side("athlete_id", name), like=like, near=similar.edit_pairs)
    assert most_rows(out) < n * n
    assert {(x.key, x.athlete_id, x.method) for x in out.collect()} == {(i, i, "fuzzy") for i in range(n)}


def test_staged_candidates_meet_names(spark):
    n = 300
    nba = spark.range(n).select(F.col("id").alias("nba_id"), F.lit("ann ray").alias("player_name"), F.lit(2000).alias("draft_year_proxy"))
    college = spark.range(n).select(F.col("id").alias("athlete_id"), F.lit("ann ray").alias("athlete_name"), (F.lit(1990) + F.col("id") % 2 * 9).alias("final_season"), F.lit(0).alias("shot_events"))
    found, missing = matching.staged_candidates(nba, college)
    assert most_rows(missing) <= 2 * n and missing.count() == 0
    assert found.count() == n * n // 2 and found.where("athlete_id % 2 = 0").count() == 0


def test_many_to_many_deals_rows_of_a_key(spark):
    side = lambda c, m: spark.range(m).select((F.col("id") % 3).alias("k"), F.col("id").alias(c))
    left, right = side("a", 60), side("b", 90).unionByName(side("b", 9))
    got = joins.many_to_many(left, right, ["k"], 4)
    assert sorted(map(tuple, got.select("k", "a", "b").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    assert got.groupBy(F.spark_partition_id()).count().count() > 3


def test_id_pairs_are_made_in_many_tasks(spark):
    side = lambda x, m: spark.range(m).select(F.col("id").alias(x), F.when(F.col("id") % 10 > 0, 7).alias(f"{x}i"), F.concat(F.lit(" N"), F.col("id") % 20).alias(f"{x}n"))
    a, b = side("a", 100), side("b", 7000)
    out = joins.by_id_or_name(a, b, "ai", "bi", "an", "bn")
    assert out.groupBy(F.spark_partition_id()).count().where("count > 90 * 1000").count() >= 2
    assert out.count() == 90 * 6300 + sum(1 for i in range(100) for j in range(7000) if i % 20 == j % 20 and (i % 10 == 0 or j % 10 == 0))


def test_lineups_round_seconds_as_their_sql_does(spark, tmp_path):
    import duckdb
    import pandas as pd

    from fastbreak import model_queries, queries
    from tests.helpers import rows

    # u01 comes in at the last row only if 35.6 seconds count as 36, and so as the next unit, the first of the window
    at = lambda unit, s: pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=unit * 36 + s)
    acts = [(u, at(50, 1), "view") for u in (3, 5, 7, 9, 11) for _ in range(3)] + [(1, at(99, 35.6), "view"), (13, at(100, 1), "view"), (3, at(699, 1), "purchase"), (5, at(700, 1), "view")]
    pd.DataFrame([(i, u, ts, k, 1.0) for i, (u, ts, k) in enumerate(acts)], columns=["event_id", "user_id", "ts", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = model_queries.plan_windowed_lineups(spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.execute(queries.SQL["plan_windowed_lineups"]).df())


def test_candidates_shuffle_rows_not_pairs(spark):
    n = 200
    nba = spark.range(n).select(F.col("id").alias("nba_id"), F.lit("ann ray").alias("player_name"), F.lit(2000).alias("draft_year_proxy"))
    college = spark.range(n).select((F.col("id") % 150).alias("athlete_id"), F.when(F.col("id") % 2 == 0, "ray ann").otherwise("bo ann").alias("athlete_name"), F.lit(2001).alias("final_season"))
    out = matching.candidates(nba, college.where("athlete_id >= 50"))
    assert most_rows(out, "shuffleRecordsWritten") <= 4 * n
    assert sorted(map(tuple, out.select("nba_id", "athlete_id").collect())) == [(i, j) for i in range(n) for j in range(50, 150)]
    again = matching.candidates(nba.unionByName(nba), college)
    assert sorted(map(tuple, again.select("nba_id", "athlete_id").collect())) == [(i, j) for i in range(n) for j in range(150)]


def test_solve_in_tables_does_not_move_the_matrix(spark, monkeypatch):
    n = 60
    entries = [("g", f"p{i}", f"p{j}", 3.0 if i == j else 0.5) for i in range(n) for j in range(n) if abs(i - j) <= 1] + [("h", "p0", "p0", 2.0)]
    gram = spark.createDataFrame(entries, "grp string, p string, q string, v double")
    rhs = spark.createDataFrame([("g", f"p{i}", float(i % 7), 1.0) for i in range(n)] + [("h", "p0", 6.0, 1.0), ("h", "lone", 0.0, 0.0)], "grp string, p string, v double, penalty double")
    held = {(r.grp, r.p): r.x for r in ratings.solve(gram, rhs, 1e-10).collect()}
    tabled = {(r.grp, r.p): r.x for r in ratings.solve(gram, rhs, 1e-10, few=0).collect()}
    assert held.keys() == tabled.keys() and all(abs(held[k] - tabled[k]) < 1e-8 for k in held) and abs(tabled["h", "p0"] - 2) < 1e-9
    # three seasons of a million players do not fit into the driver as hash tables
    assert ratings.FEW_UNKNOWNS < 840_000


def test_simple_ratings_make_no_pairs(spark, monkeypatch):
    """Rows of 40 players have 1,600 pairs each; the fit reads their 40 entries, in several blocks and slices."""
    monkeypatch.setattr(ratings, "solve", lambda *a, **b: 1 / 0)
    monkeypatch.setattr(ratings, "BLOCK_ENTRIES", 150)
    monkeypatch.setattr(ratings, "SLICE", 7)
    rng = np.random.default_rng(8)
    rows = [([f"n{k}" for k in rng.choice(50, 40, replace=False)], float(rng.integers(1, 9)), float(rng.normal())) for _ in range(90)] + [([], 4.0, 1.0)]
    df = spark.createDataFrame(rows, "players array<string>, possessions double, net double").repartition(2)
    s = np.sqrt([w for _, w, _ in rows])
    a = np.hstack([np.ones((len(rows), 1)), s[:, None] * [[f"n{k}" in who for k in range(50)] for who, _, _ in rows]])
    want = np.linalg.solve(a.T @ a + np.diag([0.0] + [20.0] * 50), a.T @ (s * [y for _, _, y in rows]))
    got = {r.player: r.rating for r in ratings.simple_ratings(df, ridge=20.0, tol=1e-12, intercept=True).collect()}
    assert len(got) == 51 and abs(got[None] - want[0]) < 1e-8 and all(abs(got[f"n{k}"] - want[k + 1]) < 1e-8 for k in range(50))
    # suppliers of six times the larger tables: their numbers fit, and no name travels in a step
    assert ratings.FEW_COLUMNS > 360_000


def test_spearman_sorts_once_a_column(spark):
    rows = spark.createDataFrame([(i % 3, float(i * i % 11), float(i * 7 % 5), i) for i in range(90)], "g int, a double, b double, other int")
    out = agg.spearman(rows, "a", "b", ["g"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("Sort [") <= 2
    want = rows.toPandas().groupby("g").apply(lambda x: x.a.rank().corr(x.b.rank()))
    assert all(abs(r.spearman - want[r.g]) < 1e-9 for r in out.collect())
