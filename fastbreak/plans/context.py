"""Features with fallbacks, shrinkage and missing flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fastbreak.functions.rates import clip, ratio, reliability_possessions, shrink
from fastbreak.operators.windows import zscore
from fastbreak.plans.transforms import Transforms


def pathway_context(seasons: DataFrame, sources: list[str], mix: dict[str, float], volume: str = "poss", rescue: float = 0.5) -> DataFrame:
    """Impact by the first source that has it, shrunk by possessions, mixed with other z-scores; year-on-year
    velocity and quality flags. Volume overrides a low reliability where a source was used and possessions
    are in the season's top share."""
    used = F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in sources])
    df = seasons.withColumns({"impact_raw": F.coalesce(*[F.col(s) for s in sources]), "impact_source": F.coalesce(used, F.lit("none")), "reliability": F.coalesce(reliability_possessions(F.col(volume)), F.lit(0.0))})
    high = F.percent_rank().over(W.partitionBy("season").orderBy(volume)) >= 0.9
    df = df.withColumn("reliability", F.when(high & (F.col("impact_source") != "none"), F.greatest("reliability", F.lit(rescue))).otherwise(F.col("reliability")))
    df = df.withColumn("impact", F.col("impact_raw") * F.col("reliability"))
    parts = sum((F.coalesce(zscore(F.col(c), ["season"]), F.lit(0.0)) * w for c, w in mix.items()), F.lit(0.0))
    df = df.withColumn("context", parts)
    w = W.partitionBy("athlete_id").orderBy("season")
    df = df.withColumn("velocity", F.col("impact") - F.lag("impact").over(w))
    seen = F.sum(F.col("impact_raw").isNotNull().cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumns({"seasons_seen": seen, "flag_no_impact": F.col("impact_raw").isNull().cast("int"), "flag_low_volume": (F.coalesce(F.col(volume), F.lit(0)) < 200).cast("int"), "flag_no_velocity": F.col("velocity").isNull().cast("int")})


def enhanced_features(splits: DataFrame, least: int = 10) -> DataFrame:
    """Rates of a player-season from its leverage splits (rows: season, athlete_id, leverage, counts), each
    with a missing flag; fewer than `least` attempts give null."""
    c = lambda lev, col: F.sum(F.when(F.col("leverage") == lev, F.col(col)))
    cols = ["rim_made", "rim_att", "three_made", "three_att", "ft_made", "ft_att", "mid_made", "mid_att", "assisted_made"]
    wide = splits.groupBy("season", "athlete_id").agg(*[c(lev, x).alias(f"{x}_{lev.lower()}") for lev in ("ALL", "HIGH", "GARBAGE") for x in cols])
    a = lambda x, lev="all": F.coalesce(F.col(f"{x}_{lev}"), F.lit(0))
    fga = lambda lev: a("rim_att", lev) + a("mid_att", lev) + a("three_att", lev)
    gated = lambda m, t: F.when(t >= least, m / t)
    rim_high, rim_all = gated(a("rim_made", "high"), a("rim_att", "high")), gated(a("rim_made"), a("rim_att"))
    made = {
        "three_shrunk": F.when(a("three_att") > 0, shrink(a("three_made"), a("three_att"))),
        "ft_shrunk": F.when(a("ft_att") > 0, shrink(a("ft_made"), a("ft_att"))),
        "rim_rate": gated(a("rim_att"), fga("all")),
        "three_rate": gated(a("three_att"), fga("all")),
        "ft_rate": gated(a("ft_att"), fga("all")),
        "assisted_share": gated(a("assisted_made"), a("rim_made") + a("mid_made") + a("three_made")),
        "clutch_rim_gain": rim_high - rim_all,
        "high_leverage_share": ratio(fga("high").cast("double"), fga("all") - fga("garbage")),
        "garbage_share": gated(fga("garbage"), fga("all")),
    }
    out = wide.select("season", "athlete_id", *[v.alias(k) for k, v in made.items()])
    return out.withColumns({f"{k}_missing": F.col(k).isNull().cast("int") for k in made})


def advanced_features(base: DataFrame, high: DataFrame, low: DataFrame, least: int = 10) -> DataFrame:
    """Thirteen rates of a player-season, each with a missing flag, from its totals and those of its high and low leverage plays.

    base: season, athlete_id and totals; high, low: the same keys with fga_total, ft_att, ft_made,
    rim_made, mid_made, three_made, tov_total and (high) shots_total, one row a key.
    """
    c = lambda x: F.col(x).cast("double")
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    enough = lambda x, v, k=least: F.when(c(x) >= k, v)
    tries = c("fga_total") + 0.44 * c("ft_att")
    scored = 2 * c("rim_made") + 3 * c("three_made") + 2 * c("mid_made") + c("ft_made")
    lost = F.when(tries + c("tov_total") > 10, c("tov_total") / (tries + c("tov_total")))
    shooting = F.when(tries > 10, scored / (2 * tries))
    side = lambda df, n, *more: df.select("season", "athlete_id", lost.alias(f"_lost_{n}"), shooting.alias(f"_ts_{n}"), *more)
    wide = base.join(side(high, "high", c("shots_total").alias("_shots_high")), ["season", "athlete_id"], "left").join(side(low, "low"), ["season", "athlete_id"], "left")
    steals, blocks, fouls = (F.when(c("poss") >= 50, c(x) / c("poss")) for x in ("stl_total", "blk_total", "pf_total"))
    made, helped = zero("rim_made") + zero("mid_made") + zero("three_made"), zero("assisted_made")
    own = made - helped
    found = {
        "dunk_rate": enough("rim_att", shrink(c("dunk_att"), c("rim_att"))),
        "dunk_freq": enough("fga_total", c("dunk_att") / c("fga_total")),
        "putback_rate": enough("orb_total", c("putback_att") / (c("orb_total") + 1), 5),
        "transition_freq": enough("fga_total", c("transition_att") / c("fga_total")),
        "transition_eff": enough("transition_att", shrink(c("transition_made"), c("transition_att"))),
        "rim_pressure_index": F.when(c("poss") > 0, enough("fga_total", (c("rim_att") + 0.44 * c("ft_att")) / c("poss"))),
        "deflection_proxy": F.when(F.coalesce(steals, blocks).isNotNull(), 1.5 * F.coalesce(steals, F.lit(0.0)) + 0.5 * F.coalesce(blocks, F.lit(0.0))),
        "contest_proxy": blocks / (blocks + fouls + 0.01),
        "pressure_handle_proxy": F.col("_lost_high") - F.col("_lost_low"),
        "clutch_shooting_delta": F.col("_ts_high") - F.col("_ts_low"),
        "self_creation_rate": F.when(made >= least, own / made),
        "self_creation_eff": F.when(own >= 5, shrink(own, own * 1.5)),
        "leverage_poss_share": enough("shots_total", F.coalesce("_shots_high", F.lit(0.0)) / c("shots_total")),
    }
    out = wide.select("season", "athlete_id", *[v.alias(k) for k, v in found.items()])
    return out.withColumns({f"{k}_missing": F.col(k).isNull().cast("int") for k in found})


def unified(base: DataFrame, features: dict[str, DataFrame], on: list[str], target: DataFrame | None = None, mode: str = "supervised", forbidden: set[str] = frozenset(), transforms: Transforms | None = None, fit_on: Column | None = None) -> DataFrame:
    """A star of left joins on `on`, each source flagged has_<name>.

    supervised keeps rows with a target, foundation drops the targets, joint keeps all rows with a mask.
    Base and feature tables must be unique on the keys, the target on those of them it has, and a table
    that is not raises an error when it is read; the result has one row per base key. `transforms` are
    fitted on the joined rows for which `fit_on` holds (all without it), whatever the mode, and applied
    to all; tables that came with them are applied as they are.
    """
    if mode not in ("supervised", "foundation", "joint"):
        raise ValueError(f"unknown mode {mode!r}")

    def unique(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
        n = F.count("*").over(W.partitionBy(*keys))
        return df.withColumn("_n", n).where((F.col("_n") == 1) | F.assert_true(F.col("_n") == 1, F.lit(f"{name} repeats a key")).isNull()).drop("_n")

    out = unique(base, "base", on)
    for name, df in features.items():
        bad = forbidden & set(df.columns)
        if bad:
            raise ValueError(f"{name} holds target columns {sorted(bad)}")
        out = out.join(unique(df, name, on).withColumn(f"has_{name}", F.lit(1)), on, "left").fillna({f"has_{name}": 0})
    if transforms is not None:
        if not transforms.tables:
            transforms.fit(out if fit_on is None else out.where(fit_on))
        out = transforms.apply(out)
    if target is None or mode == "foundation":
        return out
    keys = [c for c in on if c in target.columns]
    cols = [c for c in target.columns if c not in keys]
    out = out.join(unique(target, "target", keys), keys, "inner" if mode == "supervised" else "left")
    return out.withColumns({f"{c}_mask": F.col(c).isNotNull().cast("int") for c in cols})


def exposure_volume(df: DataFrame, seconds: str, poss: str) -> DataFrame:
    return df.withColumn("volume_reliability", F.greatest(clip(F.col(seconds) / 3000, 0.0, 1.0), F.coalesce(reliability_possessions(F.col(poss)) * 0.65, F.lit(0.0))))
