import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fastbreak.operators import joins
from fastbreak.plans import context, transforms
from fastbreak.sources.catalog import Catalog


def frame(seed=0, n=120):
    rng = np.random.default_rng(seed)
    p = pd.DataFrame({"k": range(n), "season": rng.integers(2000, 2004, n), "team": rng.choice(list("abc"), n), "x": rng.normal(size=n), "y": rng.normal(size=n)})
    p.loc[rng.random(n) < 0.3, "y"] = np.nan
    p.loc[p.season == 2003, "x"] = 5.0
    return p


def spark_frame(spark, p):
    return spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in p.itertuples(index=False)], "k long, season int, team string, x double, y double")


def made():
    return transforms.Transforms("season", ["team", "season"], [["team", "season"], ["team"], []], ["x"], ["x", "y"], ["y"], least=6)


def test_transforms_against_pandas(spark, tmp_path):
    p = frame()
    df = spark_frame(spark, p).unionByName(spark.createDataFrame([(900, 1990, "a", 1.0, None), (901, None, None, 2.0, float("nan"))], "k long, season int, team string, x double, y double"))
    fitted = made().fit(df.where("k < 80"))
    got = {r["k"]: r for r in fitted.apply(df).collect()}
    assert len(got) == len(p) + 2
    f = p[p.k < 80]
    for r in p.itertuples():
        own = f[f.season == r.season].x
        sd = own.std() if own.std() > 0 else 1
        assert np.isclose(got[r.k]["x_z"], (r.x - own.mean()) / sd)
        assert np.isclose(got[r.k]["x_resid"], r.x - f[(f.season == r.season) & (f.team == r.team)].x.mean())
        if np.isnan(r.y):
            level, rows = next((i, s) for i, s in enumerate((f[(f.team == r.team) & (f.season == r.season)].y, f[f.team == r.team].y, f.y)) if s.count() >= 6)
            assert got[r.k]["y_source"] == f"imputed:{level}" and np.isclose(got[r.k]["y_filled"], rows.mean()) and np.isclose(got[r.k]["y_sd"], rows.std())
        else:
            assert got[r.k]["y_source"] == "measured" and got[r.k]["y_filled"] == r.y and got[r.k]["y_sd"] == 0
    assert np.isclose(got[900]["x_z"], (1 - f.x.mean()) / f.x.std()) and got[900]["x_resid"] is None
    assert got[901]["y_source"] == "imputed:2" and got[901]["x_resid"] is None
    c = Catalog(spark, str(tmp_path))
    fitted.save(c, "m")
    again = {r["k"]: r for r in made().load(c, "m").apply(df).collect()}
    assert {k: str(r) for k, r in again.items()} == {k: str(r) for k, r in got.items()}


def test_unseen_rows_and_nothing_fitted(spark):
    df = spark_frame(spark, frame(1, 10))
    empty = made().fit(df.limit(0)).apply(df).collect()
    assert len(empty) == 10 and all(r["x_z"] is None and r["y_source"] in ("measured", "missing") for r in empty)


def test_combined_and_tagged_override(spark):
    df = spark.createDataFrame([(1, 2.0, 9.0, 0.5), (2, None, 9.0, 0.5), (3, None, None, None)], "k int, m double, i double, s double")
    got = {r["k"]: (r["v"], r["v_uncertainty"], r["v_source"]) for r in transforms.combined(df, "m", "i", "s", "v").collect()}
    assert got == {1: (2.0, 0.0, "measured"), 2: (9.0, 0.5, "imputed"), 3: (None, None, "missing")}
    twice = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, m double")
    with pytest.raises(Exception, match="repeats a key"):
        joins.override_tagged(df.select("k", "m"), twice, ["k"]).collect()


def test_unified_modes_and_repeated_targets(spark):
    base = spark.createDataFrame([(1, 2000), (2, 2000), (3, 2001)], "k int, season int")
    box = spark.createDataFrame([(1, 2000, 1.0), (2, 2000, 3.0), (3, 2001, None)], "k int, season int, x double")
    once, twice = spark.createDataFrame([(1, 5.0)], "k int, y double"), spark.createDataFrame([(1, 5.0), (1, 6.0)], "k int, y double")
    for mode, rows in (("supervised", 1), ("foundation", 3), ("joint", 3)):
        fitted = transforms.Transforms("season", ["season"], [["season"], []], ["x"], ["x"], ["x"])
        got = context.unified(base, {"box": box}, ["k", "season"], once, mode, transforms=fitted, fit_on=F.col("season") == 2000).collect()
        assert len(got) == rows and {r["x_resid"] for r in got if r["k"] == 1} == {-1.0}
        assert ("y_mask" in got[0].asDict()) == (mode != "foundation")
        if mode != "supervised":
            assert {r["k"]: r["x_source"] for r in got} == {1: "measured", 2: "measured", 3: "imputed:1"}
    for mode in ("supervised", "joint"):
        with pytest.raises(Exception, match="target repeats a key"):
            context.unified(base, {"box": box}, ["k", "season"], twice, mode).collect()
    with pytest.raises(ValueError, match="unknown mode"):
        context.unified(base, {}, ["k", "season"], once, "other")
