"""Latent trajectories: a local linear trend per player by Kalman filter and smoother.

Level and slope move by random steps whose variances, in units of the noise, are fitted by likelihood;
the first two values start the filter exactly (a flat prior on level and slope). A horizon bounds a
player's values, so they are collected as one short list; players of a batch are then filtered and
smoothed together, one numpy operation a season for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HORIZON, FLAT, LEAST = 7, 0.05, 2
#: Candidate variances of the steps of level and slope, as multiples of the noise; the search then halves its steps this often.
RATIOS, HALVINGS = (0.0, *(10.0**k for k in np.arange(-3.0, 3.01, 0.5))), 12
TINY = 1e-12


def start(y: np.ndarray, r: np.ndarray, q: np.ndarray):
    """Mean and covariance of level and slope after two values, from a flat prior."""
    mean = np.stack([y[:, 1], y[:, 1] - y[:, 0]], 1)
    one = np.ones(len(y))
    return mean, np.stack([np.stack([one, one], 1), np.stack([one, 2 + r + q], 1)], 1)


def predicted(mean: np.ndarray, cov: np.ndarray, r: np.ndarray, q: np.ndarray):
    m = np.stack([mean[:, 0] + mean[:, 1], mean[:, 1]], 1)
    a = cov[:, 0, 0] + 2 * cov[:, 0, 1] + cov[:, 1, 1] + r
    b = cov[:, 0, 1] + cov[:, 1, 1]
    return m, np.stack([np.stack([a, b], 1), np.stack([b, cov[:, 1, 1] + q], 1)], 1)


def filtered(y: np.ndarray, r: np.ndarray, q: np.ndarray):
    """Per season from the second: predicted and filtered moments; with them the concentrated log-likelihood and the noise variance."""
    mean, cov = start(y, r, q)
    steps, squares, logs = [(None, None, mean, cov)], np.zeros(len(y)), np.zeros(len(y))
    for t in range(2, y.shape[1]):
        pm, pc = predicted(mean, cov, r, q)
        f, v = pc[:, 0, 0] + 1.0, y[:, t] - pm[:, 0]
        gain = pc[:, :, 0] / f[:, None]
        mean, cov = pm + gain * v[:, None], pc - gain[:, :, None] * pc[:, None, 0, :]
        squares, logs = squares + v * v / f, logs + np.log(f)
        steps.append((pm, pc, mean, cov))
    n = max(y.shape[1] - 2, 1)
    noise = squares / n
    return steps, -0.5 * (n * np.log(np.maximum(noise, TINY)) + logs), noise


def fitted(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step variances of largest likelihood for each row: the best of a grid, then steps of halving length around it; of equal ones the smallest."""
    best, r, q = np.full(len(y), -np.inf), np.zeros(len(y)), np.zeros(len(y))
    if y.shape[1] < 4:  # the likelihood of three values is the same for all
        return r, q

    def take(a: np.ndarray, b: np.ndarray) -> None:
        like = filtered(y, a, b)[1]
        won = like > best + 1e-9
        best[won], r[won], q[won] = like[won], a[won], b[won]

    for a in RATIOS:
        for b in RATIOS:
            take(np.full(len(y), a), np.full(len(y), b))
    step = 10.0**0.25
    for _ in range(HALVINGS):
        for fa, fb in ((step, 1), (1 / step, 1), (1, step), (1, 1 / step)):
            take(np.minimum(r * fa, RATIOS[-1]), np.minimum(q * fb, RATIOS[-1]))
        step = np.sqrt(step)
    return r, q


def smoothed(y: np.ndarray, r: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed levels and slopes of all seasons, and the noise variance."""
    steps, _, noise = filtered(y, r, q)
    mean = steps[-1][2]
    means = [mean]
    for (pm, pc, _, _), (_, _, m, c) in zip(steps[:0:-1], steps[-2::-1], strict=True):
        reach = np.stack([np.stack([c[:, 0, 0] + c[:, 0, 1], c[:, 0, 1]], 1), np.stack([c[:, 0, 1] + c[:, 1, 1], c[:, 1, 1]], 1)], 1)
        gain = np.matmul(reach, np.linalg.inv(pc))
        mean = m + np.einsum("nij,nj->ni", gain, mean - pm)
        means.append(mean)
    # the first season: its value and what the second one tells, in the limit of the flat prior
    left = y[:, 0] - mean[:, 0] + mean[:, 1]
    total = 1 + r + q
    slope = (q * (mean[:, 0] - y[:, 0]) + (1 + r) * mean[:, 1]) / total
    means.append(np.stack([y[:, 0] - left / total, slope], 1))
    both = np.stack(means[::-1], 1)
    return both[:, :, 0], both[:, :, 1], noise


def trajectories(seasons: DataFrame, who: str, season: str, stat: str, years: int = HORIZON, flat: float = FLAT, ratios: tuple[float, float] | None = None) -> DataFrame:
    """One row per player: latent_peak, last_slope, plateau (1.0 where the slope is below `flat`), n_used, censored, and the variances.

    The first `years` seasons with a value count, by season, equal ones by value; censored is 1 where a
    player has fewer. Fewer than two values give nulls. `ratios` fixes the step variances of level and
    slope in units of the noise instead of fitting them; (0, 0) is a straight line.
    """
    s = seasons.select(F.col(who).alias("who"), F.col(season).cast("double").alias("at"), F.col(stat).cast("double").alias("y")).where("who IS NOT NULL AND at IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)")
    first = s.withColumn("i", F.row_number().over(W.partitionBy("who").orderBy("at", "y"))).where(F.col("i") <= years)
    lists = first.groupBy("who").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda x: x["y"]).alias("ys"))
    names = ("latent_peak", "last_slope", "plateau", "level_ratio", "slope_ratio", "noise")

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = batch.column("ys").to_pylist()
            size = np.array([len(v) for v in ys])
            out = np.full((len(ys), len(names)), np.nan)
            for n in np.unique(size[size >= LEAST]):
                rows = np.flatnonzero(size == n)
                y = np.array([ys[k] for k in rows])
                r, q = fitted(y) if ratios is None else (np.full(len(y), float(x)) for x in ratios)
                level, slope, noise = smoothed(y, r, q)
                last = slope[:, -1]
                out[rows] = np.stack([level.max(1), last, (last < flat).astype(float), r, q, noise], 1)
            cols = [pa.array(out[:, k], pa.float64(), from_pandas=True) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("who"), *cols, pa.array(size, pa.int64()), pa.array((size < years).astype(np.int64))], names=["who", *names, "n_used", "censored"])

    kind = lists.schema["who"].dataType.simpleString()
    out = lists.mapInArrow(batches_of, f"who {kind}, {', '.join(f'{c} double' for c in names)}, n_used bigint, censored bigint")
    return out.withColumnRenamed("who", who)
