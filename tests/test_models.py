"""Fitted models against dense or brute-force solutions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fastbreak.plans import development, impact, ratings, trajectories


def dense_em(x, seasons, summary, floor, ridge, least_noise, most):
    """Plain loops over players: posterior by adding outer products, then the parameters."""
    n, p = x.shape
    B, S = np.zeros((2, p)), np.diag([1.0, 0.25])
    s1 = max(np.var([y for rows in seasons for _, y, _ in rows]), least_noise)
    s2 = max(np.var([v[0] for v in summary if v]), least_noise) if any(summary) else s1
    for _ in range(most):
        means, covs, left1, left2 = [], [], [], []
        for i in range(n):
            precision, rhs = np.linalg.inv(S), np.linalg.inv(S) @ (B @ x[i])
            seen = [(np.array([1.0, t - 1.0]), y, max(w or 0, floor), 1) for t, y, w in seasons[i]]
            if summary[i]:
                seen.append((np.array([1.0, 1.0]), summary[i][0], max(summary[i][1] or 0, floor), 2))
            for h, y, w, kind in seen:
                precision = precision + w / (s1 if kind == 1 else s2) * np.outer(h, h)
                rhs = rhs + w / (s1 if kind == 1 else s2) * h * y
            cov = np.linalg.inv(precision)
            m = cov @ rhs
            for h, y, w, kind in seen:
                (left1 if kind == 1 else left2).append(w * ((y - h @ m) ** 2 + h @ cov @ h))
            means.append(m)
            covs.append(cov)
        m = np.array(means)
        B = np.linalg.solve(x.T @ x + ridge * np.eye(p), x.T @ m).T
        c = m - x @ B.T
        S = sum(covs[i] + np.outer(c[i], c[i]) for i in range(n)) / n + ridge * np.eye(2)
        s1 = max(np.mean(left1), least_noise)
        s2 = max(np.mean(left2), least_noise) if left2 else s2
    return np.array(means), np.array(covs), B, S, s1, s2


def test_development_equals_dense_em(spark):
    rng = np.random.default_rng(0)
    n = 60
    cov = rng.normal(size=n)
    level, slope = 1 + 0.5 * cov + rng.normal(size=n) * 0.7, 0.2 - 0.1 * cov + rng.normal(size=n) * 0.3
    seasons = [[(t, float(level[i] + (t - 1) * slope[i] + rng.normal() * 0.5), float(w) if w else None) for t in range(1, 1 + i % 5) for w in [rng.integers(0, 9)]] for i in range(n)]
    summary = [(float(level[i] + slope[i] + rng.normal()), 4.0) if i % 3 else None for i in range(n)]
    players = spark.createDataFrame([(i, float(cov[i])) for i in range(n)], "athlete_id long, z double")
    s = spark.createDataFrame([(i, *r) for i in range(n) for r in seasons[i]] + [(3, 2, None, 5.0)], "athlete_id long, t int, y double, w double")
    m = spark.createDataFrame([(i, *summary[i]) for i in range(n) if summary[i]], "athlete_id long, y double, w double")
    x = np.stack([np.ones(n), cov], 1)
    out, fit = development.development_em(players, s, m, covariates=("z",), tol=0.0, most=6)
    _, _, B, S, s1, s2 = dense_em(x, seasons, summary, 1.0, 1e-3, 1e-4, 6)
    assert np.allclose(fit.regression, B) and np.allclose(fit.covariance, S) and np.isclose(fit.noise, s1) and np.isclose(fit.noise_summary, s2)
    means, covs, *_ = dense_em(x, seasons, summary, 1.0, 1e-3, 1e-4, 7)
    got = {r["athlete_id"]: r for r in out.collect()}
    assert len(got) == n
    for i in range(n):
        assert np.allclose([got[i]["level"], got[i]["slope"]], means[i]) and np.isclose(got[i]["slope_sd"] ** 2, covs[i][1, 1]) and got[i]["p10"] < got[i]["p50"] < got[i]["p90"]
    _, fit = development.development_em(players, s, m, covariates=("z",), most=500)
    assert fit.settled and fit.iterations < 500


def test_development_without_values(spark):
    players = spark.createDataFrame([(1,), (2,)], "athlete_id long")
    none = spark.createDataFrame([], "athlete_id long, t int, y double, w double")
    out, fit = development.development_em(players, none, most=3)
    assert out.count() == 2 and np.allclose(fit.regression, 0)
    out, _ = development.development_em(players.limit(0), none)
    assert out.count() == 0


def dense_trend(y, r, q):
    """Means of levels and slopes given the values, by joint Gaussians with a nearly flat prior; log-likelihood of the values after the first two."""
    n = len(y)
    a = np.array([[1.0, 1.0], [0.0, 1.0]])
    big = 1e7
    cov = np.zeros((2 * n, 2 * n))
    cov[:2, :2] = big * np.eye(2)
    for t in range(1, n):
        cov[2 * t : 2 * t + 2, : 2 * t] = a @ cov[2 * t - 2 : 2 * t, : 2 * t]
        cov[: 2 * t, 2 * t : 2 * t + 2] = cov[2 * t : 2 * t + 2, : 2 * t].T
        cov[2 * t : 2 * t + 2, 2 * t : 2 * t + 2] = a @ cov[2 * t - 2 : 2 * t, 2 * t - 2 : 2 * t] @ a.T + np.diag([r, q])
    h = np.zeros((n, 2 * n))
    h[np.arange(n), 2 * np.arange(n)] = 1
    s = h @ cov @ h.T + np.eye(n)
    state = cov @ h.T @ np.linalg.solve(s, y)
    head = s[:2, :2]
    given = s[2:, 2:] - s[2:, :2] @ np.linalg.solve(head, s[:2, 2:])
    mean = s[2:, :2] @ np.linalg.solve(head, y[:2])
    e = y[2:] - mean
    noise = e @ np.linalg.solve(given, e) / max(n - 2, 1)
    like = -0.5 * ((n - 2) * np.log(max(noise, 1e-12)) + np.linalg.slogdet(given)[1])
    return state[::2], state[1::2], like


@pytest.mark.parametrize("ratios", list(itertools.product((0.0, 0.3, 20.0), repeat=2)))
def test_smoother_equals_dense_gaussian(ratios):
    rng = np.random.default_rng(1)
    for n in (2, 3, 5, 7):
        y = rng.normal(size=(6, n)).cumsum(1)
        level, slope, _ = trajectories.smoothed(y, np.full(6, ratios[0]), np.full(6, ratios[1]))
        like = trajectories.filtered(y, np.full(6, ratios[0]), np.full(6, ratios[1]))[1]
        for k in range(6):
            a, b, c = dense_trend(y[k], *ratios)
            assert np.allclose(level[k], a, atol=1e-4) and np.allclose(slope[k], b, atol=1e-4)
            assert n < 4 or np.isclose(like[k], c, atol=1e-4)


def test_variances_have_the_largest_likelihood():
    rng = np.random.default_rng(2)
    y = rng.normal(size=(20, 7)).cumsum(1) + rng.normal(size=(20, 7))
    r, q = trajectories.fitted(y)
    best = trajectories.filtered(y, r, q)[1]
    for _ in range(300):
        a, b = 10 ** rng.uniform(-3, 3, 20) * rng.integers(0, 2, 20), 10 ** rng.uniform(-3, 3, 20) * rng.integers(0, 2, 20)
        assert (trajectories.filtered(y, a, b)[1] <= best + 0.02).all()


def test_trajectories(spark):
    rows = [(1, t, float(t)) for t in range(9)] + [(2, 5, 1.0)] + [(3, t, 2.0 - t) for t in range(3)] + [(4, 1, None), (4, 2, float("nan")), (None, 1, 1.0)]
    got = {r["p"]: r for r in trajectories.trajectories(spark.createDataFrame(rows, "p int, s int, v double"), "p", "s", "v").collect()}
    assert set(got) == {1, 2, 3}
    assert np.isclose(got[1]["latent_peak"], 6) and np.isclose(got[1]["last_slope"], 1) and got[1]["plateau"] == 0 and (got[1]["n_used"], got[1]["censored"]) == (7, 0)
    assert got[2]["latent_peak"] is None and got[2]["n_used"] == 1 and got[3]["plateau"] == 1 and np.isclose(got[3]["latent_peak"], 2)


def equations(rng, n, groups=("a", "b")):
    gram, rhs, dense = [], [], {}
    for g in groups:
        m = rng.normal(size=(3 * n, n)) * (rng.random((3 * n, n)) < 0.2)
        full, v, penalty = m.T @ m, rng.normal(size=n), np.full(n, 0.5)
        gram += [(g, f"p{i}", f"p{j}", float(full[i, j])) for i in range(n) for j in range(n) if full[i, j]]
        rhs += [(g, f"p{i}", float(v[i]), 0.5) for i in range(n)]
        dense[g] = np.linalg.solve(full + np.diag(penalty), v)
    return gram, rhs, dense


@pytest.mark.parametrize("few", [1000, 0])
def test_conjugate_gradients_equal_the_dense_solution(spark, few):
    gram, rhs, dense = equations(np.random.default_rng(4), 12)
    rhs += [("c", "alone", 3.0, 2.0), ("c", "free", 1.0, 0.0)]
    g, v = spark.createDataFrame(gram, "grp string, p string, q string, v double"), spark.createDataFrame(rhs, "grp string, p string, v double, penalty double")
    found = ratings.solve(g, v, 1e-10, few)
    got = {(r["grp"], r["p"]): r["x"] for r in found.collect()}
    assert len(got) == 26 and np.isclose(got["c", "alone"], 1.5) and got["c", "free"] == 0
    for k, x in dense.items():
        assert np.allclose([got[k, f"p{i}"] for i in range(12)], x, atol=1e-7)
    checked = {r["grp"]: r["residual"] for r in ratings.residuals(g, v.where("p <> 'free'"), found).collect()}
    assert max(checked.values()) < 1e-8


@pytest.mark.parametrize("few", [1000, 0])
def test_simple_ratings_equal_the_dense_solution(spark, few):
    rng = np.random.default_rng(5)
    names = [f"n{i}" for i in range(9)]
    rows = [([names[k] for k in rng.choice(9, 3, replace=False)], float(rng.integers(0, 30)), float(rng.normal())) for _ in range(60)]
    rows += [(["n0", "n0", None], 4.0, None), (None, 2.0, 1.0), (["n1"], None, 3.0), (["n2"], -3.0, 1.0)]
    x, s, y = np.zeros((len(rows), 9)), np.zeros(len(rows)), np.zeros(len(rows))
    for k, (who, w, v) in enumerate(rows):
        s[k], y[k] = max(w or 0, 0) ** 0.5, v or 0
        for p in set(who or []) - {None}:
            x[k, names.index(p)] = 1
    full = np.hstack([np.ones((len(rows), 1)), x * s[:, None]])
    want = np.linalg.solve(full.T @ full + np.diag([0.0] + [20.0] * 9), full.T @ (y * s))[1:]
    got = {r["player"]: r["rating"] for r in ratings.simple_ratings(spark.createDataFrame(rows, "players array<string>, possessions double, net double"), ridge=20.0, few=few).collect()}
    assert np.allclose([got[p] for p in names], want, atol=1e-6) and len(got) == 9
    assert ratings.simple_ratings(spark.createDataFrame([], "players array<string>, possessions double, net double")).count() == 0


def test_ratings_by_tables_equal_those_in_the_driver(spark):
    rng = np.random.default_rng(6)
    rows = [(2000 + k % 2, f"g{k}", 1, list(rng.choice(list("abcdefgh"), 2, replace=False)), list(rng.choice(list("ijklmnop"), 2, replace=False)), 0, int(rng.integers(0, 9)), 0, int(rng.integers(0, 9)), float(rng.integers(1, 9))) for k in range(80)]
    df = spark.createDataFrame(rows, "season int, gameId string, stint int, home array<string>, away array<string>, h0 int, h1 int, a0 int, a1 int, poss double")
    a, b = ({(r["season"], r["player"]): r["rapm"] for r in impact.rapm(df, 10.0, 1e-9, few=few).collect()} for few in (1000, 0))
    assert a.keys() == b.keys() and len(a) == 32 and all(abs(a[k] - b[k]) < 1e-6 for k in a)
    assert impact.rapm(df.where("false")).count() == 0 and F is not None


@pytest.mark.parametrize("few,most", [(1000, 1000), (1000, 20), (1000, 0), (0, 0)])
def test_signed_ratings_in_tasks_parts_and_steps_are_dense(spark, few, most):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(90):
        block = "abcdef" if k % 3 else "uvwx" if k % 2 else "yz"  # players of different blocks never meet
        who = [str(x) for x in rng.choice(list(block), min(1 + k % 4, len(block)), replace=False)]
        rows.append((2000 + k % 2, k, who, [1 if i % 2 == 0 else -1 for i in range(len(who))], float(rng.integers(1, 9)), float(rng.normal())))
    rows += [(2000, 90, ["a", None], [1, -1], 2.0, 1.0), (2000, 91, ["a"], [1], 0.0, 9.0), (None, 92, ["a"], [1], 1.0, 9.0), (2001, 93, [], [], 3.0, 5.0)]
    df = spark.createDataFrame(rows, "grp int, key int, who array<string>, sign array<int>, w double, y double")
    got = {(r["grp"], r["p"]): (r["x"], r["w"]) for r in ratings.signed_ratings(df, 2.0, 1e-10, few, most).collect()}
    for season in (2000, 2001):
        own = [r for r in rows if r[0] == season and r[4] > 0]
        names = sorted({p for r in own for p in r[2] if p})
        x, w, y = np.zeros((len(own), len(names))), np.array([r[4] for r in own]), np.array([r[5] for r in own])
        for i, r in enumerate(own):
            for p, s in zip(r[2], r[3], strict=True):
                if p:
                    x[i, names.index(p)] += s
        want = np.linalg.solve(x.T @ (w[:, None] * x) + 2 * np.eye(len(names)), x.T @ (w * (y - w @ y / w.sum())))
        assert sorted(p for g, p in got if g == season) == names
        assert np.allclose([got[season, p][0] for p in names], want, atol=1e-6) and np.allclose([got[season, p][1] for p in names], np.abs(x).T @ w)


def test_parts_hold_players_that_meet_and_no_more_than_asked(spark):
    rows = [("g", k, [f"p{10 * (k % 4) + k % 7}", f"p{10 * (k % 4) + (k + 1) % 7}"], [1, -1], 1.0, 0.0) for k in range(200)]
    df = spark.createDataFrame(rows, "grp string, key int, who array<string>, sign array<int>, w double, y double")
    dealt, large = ratings.parted(df, 400, 150)
    units = {}
    for r in dealt.collect():
        for p in r["who"]:
            units.setdefault(p[1:-1], set()).add(r["unit"])
    assert large is None and all(len(u) == 1 for u in units.values()) and len(set.union(*units.values())) > 1
    dealt, large = ratings.parted(df, 400, 150, finish=0)
    assert dealt.count() == 0 and large.count() == 200


def test_ratings_of_a_season_take_few_jobs(spark):
    rows = [(2000, f"g{k}", 1, [f"a{k % 5}", f"b{k % 7}"], [f"c{k % 3}"], 0, k % 9, 0, k % 4, 5.0) for k in range(60)]
    df = spark.createDataFrame(rows, "season int, gameId string, stint int, home array<string>, away array<string>, h0 int, h1 int, a0 int, a1 int, poss double")
    spark.sparkContext.setJobGroup("ratings", "few jobs")
    impact.rapm(df, 10.0, 1e-9).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ratings"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 8


def test_plan_rapm_takes_every_part_of_every_order(spark):
    import duckdb

    from fastbreak import queries
    from tests.helpers import SF

    got = {(r["season"], r["player"]): (r["poss"], r["rapm"]) for r in queries.QUERIES["plan_rapm"](spark, SF).collect()}
    orders = duckdb.sql(f"SELECT year(min(l_shipdate)), list(DISTINCT l_partkey::VARCHAR ORDER BY l_partkey::VARCHAR), sum(l_quantity), sum(l_discount) FROM '{SF}/lineitem.parquet' GROUP BY l_orderkey").fetchall()
    assert {len(p) for _, p, _, _ in orders} > {1, 2, 3, 5}
    for season in {o[0] for o in orders}:
        own = [o for o in orders if o[0] == season]
        names = sorted({p for o in own for p in o[1]})
        x, w, y = np.zeros((len(own), len(names))), np.array([o[2] for o in own]), np.array([100 * (o[3] - o[2] / 1000) / o[2] for o in own])
        for i, (_, ps, _, _) in enumerate(own):
            for k, p in enumerate(ps):
                x[i, names.index(p)] = 1 if k < (len(ps) + 1) // 2 else -1
        want = np.linalg.solve(x.T @ (w[:, None] * x) + 100 * np.eye(len(names)), x.T @ (w * (y - w @ y / w.sum())))
        assert sorted(p for s, p in got if s == season) == names
        assert np.allclose([got[season, p][0] for p in names], np.abs(x).T @ w, atol=0.01) and np.allclose([got[season, p][1] for p in names], want, atol=2e-4)
