import datetime
import difflib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fastbreak.operators import aggregates, joins, ordering, predicates, sets, windows


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (None,)], "k int")
    assert {r["k"] for r in joins.not_in(left, right, "k").collect()} == {2, None}


def test_latest_prior_keeps_unmatched_rows(spark):
    left = spark.createDataFrame([(1, 10), (1, 10), (2, 5)], "k int, at int")
    right = spark.createDataFrame([(1, 9, "a"), (1, 3, "b"), (1, 11, "c")], "k int, then int, v string")
    assert sorted((r["k"], r["v"]) for r in joins.latest_prior(left, right, ["k"], "at", "then", 4).collect()) == [(1, "a"), (1, "a"), (2, None)]


def test_fuzzy_by_date(spark):
    left = spark.sql("SELECT 1 AS l_id, date'2024-01-02' AS date, 'duke' AS l_home, 'kansas' AS l_away UNION ALL SELECT 2, date'2024-01-05', 'iowa', 'drake'")
    right = spark.sql("SELECT 10 AS r_id, date'2024-01-02' AS date, 'kansas' AS r_home, 'duke' AS r_away UNION ALL SELECT 11, date'2024-01-06', 'iowa', 'drake'")
    got = {(r["l_id"], r["r_id"], r["swapped"], r["day_offset"]) for r in joins.fuzzy_by_date(left, right).collect()}
    assert got == {(1, 10, True, 0), (2, 11, False, -1)}


def test_suffix_and_unique(spark):
    l = spark.createDataFrame([(1, "smith"), (1, "jones")], "k int, a string")  # noqa: E741
    r = spark.createDataFrame([(1, "johnsmith"), (1, "tomjones"), (1, "bjones")], "k int, b string")
    assert [x["b"] for x in joins.suffix_match(l, r, ["k"], "a", "b").collect()] == ["johnsmith"]


@pytest.mark.parametrize("least", [0.8, 0.5])
def test_close_matches_against_difflib(spark, least):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    names = {"cold anvil", "old anvil", "", "a", "aa", "aaa", *(f"{word()} {word()}" for _ in range(60))}
    names |= {x[1:] for x in list(names)[:20]} | {word()[0] + x for x in list(names)[:20]}
    df = spark.createDataFrame([(x,) for x in [*names, None]], "a string")
    got = {(r["a"], r["place"], r["b"]) for r in joins.close_matches(df, df.withColumnRenamed("a", "b"), "a", "b", least=least).collect()}
    assert got == {(x, k + 1, y) for x in names for k, y in enumerate(difflib.get_close_matches(x, names, n=3, cutoff=least))}


def test_quantile_bins_match_cut_of_ranks(spark):
    df = spark.range(6)
    got = [r["b"] for r in predicates.quantile_bins(df, [F.col("id")], 4, "b").orderBy("id").collect()]
    assert got == [0, 0, 1, 2, 3, 3]


def test_stat_rules_and_tokens(spark):
    df = spark.createDataFrame([("John Smith", 1.0), ("Ann Lee", None), ("Bo", float("nan"))], "n string, v double")
    assert df.where(predicates.stat_rule(F.col("v"), "=", 1.0004)).count() == 1
    assert df.where(predicates.stat_rule(F.col("v"), "<", 5)).count() == 1
    assert df.where(predicates.stat_rule(F.col("v"), "?", 5)).count() == 3
    assert df.where(predicates.has_tokens(F.col("n"), "smi jo")).count() == 1


def test_guards(spark):
    df = spark.range(1).withColumn("y_peak", F.lit(1))
    with pytest.raises(ValueError):
        predicates.forbid(df, {"y_peak"})
    assert predicates.forbid(df, {"z"}).columns == ["id", "y_peak"]
    assert predicates.whitelist(df, ["id"], ("y_",)).columns == ["id", "y_peak"]
    assert predicates.nan_to_null(spark.createDataFrame([(math.nan,)], "v double")).first()["v"] is None
    assert predicates.stratified(spark.range(100).withColumn("g", F.col("id") % 2), ["g"], 10, 15).count() == 15


def test_wls_slope(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (3.0, 5.0, 1.0), (5.0, 1.0, 2.0), (7.0, 2.0, 3.0)], "y double, w double, x double")
    assert df.agg(*aggregates.wls_slope(F.col("x"), F.col("y"), F.col("w"))).first()["slope"] == pytest.approx(2.0)


def test_fallback_means(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0), (1, 4.0, 0.0), (2, 1.0, 1.0), (2, 5.0, 3.0)], "k int, x double, w double")
    assert {r["k"]: r["m"] for r in df.groupBy("k").agg(aggregates.wavg_or_mean(F.col("x"), F.col("w")).alias("m")).collect()} == {1: 3.0, 2: 4.0}
    assert df.where("k = 9").agg(aggregates.sum_or_zero(F.col("x")).alias("s")).first()["s"] == 0


def test_mixed_sort_puts_empties_last(spark):
    df = spark.createDataFrame([("10",), ("9%",), (None,), ("b",), ("",), ("a",)], "v string")
    tie = [F.col("v")]
    assert [r["v"] for r in ordering.mixed_sort(df, "v", False, tie).collect()][:4] == ["9%", "10", "a", "b"]
    assert [r["v"] for r in ordering.mixed_sort(df, "v", True, tie).collect()][:4] == ["10", "9%", "b", "a"]


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ordering, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ordering, "ROW_BLOCK", 16)
    rng = random.Random(4)
    data = [(i, float(rng.randrange(12)), float(rng.randrange(12))) for i in range(300)]
    df = spark.createDataFrame([*data, (300, None, 1.0)], "id long, x double, y double")
    near = ordering.nearest(df.where("id % 3 = 0"), df, "id", ["x", "y"], 4)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    got = {(r["q_id"], r["place"], r["id"]): r["distance"] for r in near.collect()}
    want = {}
    for q, x, y in data[::3]:
        for k, (d, i) in enumerate(sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), i) for i, a, b in data if i != q)[:4]):
            want[q, k + 1, i] = d
    assert got == pytest.approx(want)


def test_most_complete_and_sources(spark):
    df = spark.createDataFrame([(1, None, 1), (1, 5, 2)], "k int, a int, b int")
    assert sets.most_complete(df, ["k"], [F.col("b")]).first()["b"] == 2
    assert sets.first_source_wins([df.where("b = 1"), df.where("b = 2")], ["k"], [F.col("b")]).first()["b"] == 1


def test_periods(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([1200, 600, 10, 1190, 5, 300])], "g int, i int, s int")
    assert [r["period"] for r in windows.periods(df, ["g"], [F.col("i")], "s").orderBy("i").collect()] == [1, 1, 1, 2, 2, 3]


def test_latest_prior_with_repeated_rows(spark):
    left = spark.createDataFrame([(1, 10), (1, 10), (1, 3), (None, 10)], "k int, at int")
    right = spark.createDataFrame([(1, 4, "a"), (1, 9, "b"), (1, 9, "c"), (None, 9, "d")], "k int, seen int, v string")
    got = joins.latest_prior(left, right, ["k"], "at", "seen", 5, [F.col("v")]).select("k", "at", "v").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 10, "b"), (1, 10, "b"), (1, 3, None), (None, 10, None)]))


def test_a_day_off_only_without_a_game_that_day(spark):
    day = "l_id int, date date, l_home string, l_away string", "r_id int, date date, r_home string, r_away string"
    d = lambda n: datetime.date(2024, 1, n)
    left = spark.createDataFrame([(1, d(5), "Duke", "Kansas"), (2, d(20), "Duke", "Kansas")], day[0])
    right = spark.createDataFrame([(7, d(5), "Xxxx", "Qqqq"), (8, d(6), "Duke", "Kansas"), (9, d(21), "Kansas", "Duke")], day[1])
    got = joins.fuzzy_by_date(left, right).collect()
    assert [(r["l_id"], r["r_id"], r["swapped"], round(r["score"], 2)) for r in got] == [(2, 9, True, 0.97)]


def test_games_by_score_tiers(spark):
    d = datetime.date(2024, 1, 5)
    left = spark.createDataFrame([(1, d, "North Carolina", "Duke", 70, 60), (2, d, "Kansas", "Iowa", 50, 40), (3, d, "Texas Tech", "Baylor", 1, 2), (4, d, "Aaa", "Bbb", 3, 4)], "l_id int, date date, l_home string, l_away string, l_hp int, l_ap int")
    right = spark.createDataFrame([(10, d, "x", "y", 70, 60), (11, d, "Iowa", "Kansas", 50, 40), (12, d, "Utah", "Yale", 50, 40), (13, d, "Tech Texas", "Baylor", 9, 9)], "r_id int, date date, r_home string, r_away string, r_hp int, r_ap int")
    got = {r["l_id"]: (r["r_id"], r["method"], round(r["confidence"], 2)) for r in joins.games_by_score(left, right).collect()}
    assert got == {1: (10, "score_exact", 1.0), 2: (11, "score_teams", 0.95), 3: (13, "teams", 1.0)}


def test_ridge_against_normal_equations(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.1] + [0, 9, 2]
    y = x @ [1.0, -2.0, 30.0] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    fit = aggregates.ridge(df.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0)], df.schema)), ["a", "b", "c"], "y", 7.0)
    z = np.column_stack([np.ones(200), (x - x.mean(0)) / x.std(0)])
    want = np.linalg.solve(z.T @ z + 7.0 * np.diag([0, 1, 1, 1]), z.T @ y)
    rows_ = fit.collect()
    assert [r["coef"] for r in rows_] == pytest.approx(want.tolist())
    got = df.select(aggregates.ridge_prediction(rows_, {c: F.col(c) for c in "abc"}).alias("p")).toPandas()["p"]
    assert got.to_numpy() == pytest.approx(z @ want)


def test_nearest_skips_blocks_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(ordering, "QUERY_BLOCK", 8)
    monkeypatch.setattr(ordering, "ROW_BLOCK", 16)
    rng = np.random.default_rng(2)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.normal(size=(300, 2)) * [100, 1], rng.integers(0, 3, (80, 2)), [[1e6, 0]] * 9]))]
    df = spark.createDataFrame([*points, (1000, None, 1.0), (None, 0.0, 0.0)], "id long, x double, y double").repartition(3)
    asked = [p for p in points if p[0] % 7 == 0]
    got = {(r["q_id"], r["place"]): r["id"] for r in ordering.nearest(df.where("id % 7 = 0"), df, "id", ["x", "y"], 4).collect()}
    want = {}
    for i, x, y in asked:
        order = sorted((np.hypot(x - a, y - b), j) for j, a, b in points if j != i)
        want |= {(i, k + 1): j for k, (_, j) in enumerate(order[:4])}
    assert {k: v for k, v in got.items() if k[0] != 1000} == want
    boxes = np.array([[[float(i), 0.0], [i + 0.9, 1.0]] for i in range(200)])
    met = [len(ordering.reachable(np.array([[i, 0.0], [i + 0.5, 1.0]]), boxes, np.full(200, 16), 5)) for i in range(0, 200, 20)]
    assert max(met) <= 5
    assert ordering.nearest(df.limit(0), df, "id", ["x", "y"], 2).count() == 0 == ordering.nearest(df, df.limit(0), "id", ["x", "y"], 2).count()


def test_names_with_enough_near_neighbours_meet_few_others(spark):
    from fastbreak.operators import similar

    names = [f"Customer#{k:09d}" for k in range(0, 3000, 5)]
    df = spark.createDataFrame([(x,) for x in names], "_l string")
    near = similar.near_pairs(df, df.withColumnRenamed("_l", "_r"))
    assert near.count() < len(names) ** 2 / 10  # the characters of all these names are much the same
    got = {(r["a"], r["place"], r["b"]) for r in joins.close_matches(df.toDF("a"), df.toDF("b"), "a", "b").collect()}
    some = names[::60]
    want = {(x, k + 1, y) for x in some for k, y in enumerate(difflib.get_close_matches(x, names, n=3, cutoff=0.8))}
    assert {g for g in got if g[0] in some} == want


def test_near_pairs_are_all_within_two_deletions(spark):
    from fastbreak.operators import similar

    rng = random.Random(7)
    base = ["".join(rng.choice("abc") for _ in range(8)) for _ in range(12)]
    names = sorted({b[:i] + c + b[j:] for b in base for i in (0, 3, 8) for j in (i, i + 1, i + 2) for c in ("", "a", "zz")} | set(base))
    df = spark.createDataFrame([(x,) for x in names], "_l string")
    got = {tuple(r) for r in similar.near_pairs(df.where("length(_l) >= 7"), df.withColumnRenamed("_l", "_r")).collect()}

    def unmatched(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev, row = row, [0]
            for j, y in enumerate(b):
                row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[-1]))
        return len(a) + len(b) - 2 * row[-1]

    assert got == {(a, b) for a in names if len(a) >= 7 for b in names if unmatched(a, b) <= 2}
