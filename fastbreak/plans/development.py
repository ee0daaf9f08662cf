"""Development rates as latent levels and slopes, fitted by expectation and maximisation.

A player has a level and a yearly slope, drawn around a regression on covariates with one 2 x 2
covariance. Yearly values see level + (year - 1) x slope, a summary value sees level + slope, each with
its own noise over its weight.

Scale: one aggregation turns the yearly values into nine sums a player, which is all that any iteration
reads. The expectation step is a closed form of columns; the maximisation step is one aggregation of
posterior moments to a single row, from which the driver solves a system as small as the covariates.
No player's row reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z90 = 1.2815515655446004


@dataclass
class Fit:
    """Regression (2 x covariates) and covariance of level and slope, noise of yearly and summary values, iterations, whether they settled."""

    regression: np.ndarray
    covariance: np.ndarray = field(default_factory=lambda: np.diag([1.0, 0.25]))
    noise: float = 1.0
    noise_summary: float = 1.0
    iterations: int = 0
    settled: bool = False


def weighted_sums(seasons: DataFrame, who: str, year: str, y: str, weight: str, least_weight: float) -> DataFrame:
    """Per player the sums of weights, values and years that the posterior depends on; years count from 1, rows without a value are left out."""
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(float(least_weight)))
    h, v = F.col(year).cast("double") - 1, F.col(y).cast("double")
    return seasons.where(v.isNotNull() & h.isNotNull()).groupBy(who).agg(
        F.count("*").alias("n"), F.sum(w).alias("w0"), F.sum(w * h).alias("w1"), F.sum(w * h * h).alias("w2"), F.sum(w * v).alias("y0"), F.sum(w * h * v).alias("y1"), F.sum(w * v * v).alias("yy")
    )


def posterior(fit: Fit, x: list[Column]) -> dict[str, Column]:
    """Posterior mean (ma, md) and covariance (saa, sad, sdd) of a player's level and slope."""
    inv = np.linalg.inv(fit.covariance)
    mean = [sum((c * float(b) for c, b in zip(x, row, strict=True)), F.lit(0.0)) for row in fit.regression]
    one, two = 1.0 / fit.noise, 1.0 / fit.noise_summary
    c = F.col
    paa = c("w0") * one + c("v0") * two + float(inv[0, 0])
    pad = c("w1") * one + c("v0") * two + float(inv[0, 1])
    pdd = c("w2") * one + c("v0") * two + float(inv[1, 1])
    ra = c("y0") * one + c("z0") * two + mean[0] * float(inv[0, 0]) + mean[1] * float(inv[0, 1])
    rd = c("y1") * one + c("z0") * two + mean[0] * float(inv[1, 0]) + mean[1] * float(inv[1, 1])
    det = paa * pdd - pad * pad
    return {"saa": pdd / det, "sad": -pad / det, "sdd": paa / det, "ma": (pdd * ra - pad * rd) / det, "md": (paa * rd - pad * ra) / det}


def moments(x: list[Column]) -> list[Column]:
    """Sums that the next parameters follow from."""
    c = F.col
    sums = {f"xa{j}": v * c("ma") for j, v in enumerate(x)} | {f"xd{j}": v * c("md") for j, v in enumerate(x)}
    sums |= {"aa": c("saa") + c("ma") * c("ma"), "ad": c("sad") + c("ma") * c("md"), "dd": c("sdd") + c("md") * c("md")}
    fitted = c("ma") * c("ma") * c("w0") + 2 * c("ma") * c("md") * c("w1") + c("md") * c("md") * c("w2")
    spread = c("w0") * c("saa") + 2 * c("w1") * c("sad") + c("w2") * c("sdd")
    sums["left"] = c("yy") - 2 * (c("ma") * c("y0") + c("md") * c("y1")) + fitted + spread
    both = c("ma") + c("md")
    sums["left_summary"] = c("zz") - 2 * both * c("z0") + c("v0") * both * both + c("v0") * (c("saa") + 2 * c("sad") + c("sdd"))
    return [F.sum(v).alias(k) for k, v in sums.items()]


def next_fit(fit: Fit, m, xx: np.ndarray, players: int, values: int, summaries: int, ridge: float, least_noise: float) -> Fit:
    p = len(xx)
    xm = np.array([[m[f"xa{j}"], m[f"xd{j}"]] for j in range(p)])
    regression = np.linalg.solve(xx + ridge * np.eye(p), xm).T
    second = np.array([[m["aa"], m["ad"]], [m["ad"], m["dd"]]])
    cross = regression @ xm
    covariance = (second - cross - cross.T + regression @ xx @ regression.T) / max(players, 1) + ridge * np.eye(2)
    noise = max(m["left"] / values, least_noise) if values else fit.noise
    noise_summary = max(m["left_summary"] / summaries, least_noise) if summaries else fit.noise_summary
    return Fit(regression, covariance, noise, noise_summary, fit.iterations + 1)


def development_em(
    players: DataFrame, seasons: DataFrame, summary: DataFrame | None = None, who: str = "athlete_id", year: str = "t", y: str = "y", weight: str = "w", covariates: tuple[str, ...] = (),
    least_weight: float = 1.0, ridge: float = 1e-3, least_noise: float = 1e-4, tol: float = 1e-5, most: int = 200,
) -> tuple[DataFrame, Fit]:
    """(one row per player with level, slope, their sds and the slope's 10/50/90 % points; the fitted parameters).

    players: `who` (once each) and covariates, to which an intercept is added; nulls count as 0. seasons:
    `who`, year (from 1), value and weight. summary: the same without a year, at most one row a player.
    Weights below `least_weight` count as that. Players without any value get the regression's mean.
    `fit.settled` tells whether the parameters moved by less than `tol` within `most` iterations.
    """
    one = weighted_sums(seasons, who, year, y, weight, least_weight)
    if summary is None:
        two = players.select(who).limit(0).withColumns({"v0": F.lit(0.0), "z0": F.lit(0.0), "zz": F.lit(0.0), "k": F.lit(0).cast("bigint")})
    else:
        w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(float(least_weight)))
        v = F.col(y).cast("double")
        two = summary.where(v.isNotNull()).select(who, w.alias("v0"), (w * v).alias("z0"), (w * v * v).alias("zz"), F.lit(1).cast("bigint").alias("k"))
    x = [F.lit(1.0), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in covariates)]
    names = [f"x{j}" for j in range(len(x))]
    table = players.select(who, *(c.alias(n) for c, n in zip(x, names, strict=True))).join(one, who, "left").join(two, who, "left")
    table = table.fillna(0.0, ["w0", "w1", "w2", "y0", "y1", "yy", "v0", "z0", "zz"]).fillna(0, ["n", "k"]).persist(StorageLevel.MEMORY_AND_DISK)
    x = [F.col(n) for n in names]
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    known = table.agg(F.count("*").alias("players"), F.sum("n").alias("values"), F.sum("k").alias("summaries"), *(F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i, j in pairs)).first()
    xx = np.zeros((p, p))
    for i, j in pairs:
        xx[i, j] = xx[j, i] = known[f"x{i}_{j}"] or 0.0
    values, summaries = known["values"] or 0, known["summaries"] or 0
    spread = seasons.agg(F.var_pop(F.col(y).cast("double"))).first()[0]
    noise = max(spread if spread is not None else 1.0, least_noise)
    spread = summary.agg(F.var_pop(F.col(y).cast("double"))).first()[0] if summary is not None else None
    fit = Fit(np.zeros((2, p)), noise=noise, noise_summary=max(spread if spread is not None else noise, least_noise))
    while fit.iterations < most and known["players"]:
        m = table.withColumns(posterior(fit, x)).agg(*moments(x)).first()
        new = next_fit(fit, m, xx, known["players"], values, summaries, ridge, least_noise)
        moved = max(np.abs(new.regression - fit.regression).max(), np.abs(new.covariance - fit.covariance).max(), abs(new.noise - fit.noise), abs(new.noise_summary - fit.noise_summary))
        fit = new
        if moved < tol:
            fit.settled = True
            break
    sd = F.sqrt(F.col("sdd"))
    out = table.withColumns(posterior(fit, x)).select(
        who, "n", F.col("ma").alias("level"), F.col("md").alias("slope"), F.sqrt("saa").alias("level_sd"), sd.alias("slope_sd"),
        (F.col("md") - Z90 * sd).alias("p10"), F.col("md").alias("p50"), (F.col("md") + Z90 * sd).alias("p90"),
    )
    table.unpersist()  # the result is made anew from the tables when it is read
    return out, fit
