"""Aggregations: weighted means, modes, cubes, pivots, fits and rank metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def any_true(c: Column) -> Column:
    """Whether a condition holds in some row; unknown ones do not count, and no row gives false."""
    return F.coalesce(F.bool_or(c), F.lit(False))


def all_true(c: Column) -> Column:
    """Whether a condition holds in every row; an unknown one does not hold."""
    return F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True))


def wavg(x: Column, w: Column) -> Column:
    """sum(x w) / sum(w); rows with null x still count in the weight."""
    return F.sum(x * w) / F.nullif(F.sum(w), F.lit(0))


def wavg_present(x: Column, w: Column) -> Column:
    """Only rows with x and a positive weight."""
    ok = x.isNotNull() & (w > 0)
    return F.sum(F.when(ok, x * w)) / F.nullif(F.sum(F.when(ok, w)), F.lit(0))


def wavg_or_mean(x: Column, w: Column) -> Column:
    """Weighted mean, or the plain mean where the weights sum to 0."""
    return F.coalesce(wavg_present(x, w), F.avg(x))


def sum_or_zero(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def variance_from_moments(s: Column, ss: Column, n: Column) -> Column:
    """E[x^2] - E[x]^2, not below 0."""
    return F.when(n > 0, F.greatest(ss / n - F.pow(s / n, 2), F.lit(0.0)))


def distinct_list(c: Column, sep: str = "|") -> Column:
    return F.array_join(F.array_sort(F.collect_set(c.cast("string"))), sep)


def ordered_list(value: Column, order: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def mode_by(df: DataFrame, by: list[str], c: str, ties: list[Column] | None = None) -> DataFrame:
    """Most frequent non-null value of each group; ties by the given order, else the smallest."""
    counts = df.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("n"))
    best = W.partitionBy(*by).orderBy(F.desc("n"), *(ties or [F.col(c)]))
    return counts.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def value_shares(df: DataFrame, by: list[str], c: str) -> DataFrame:
    counts = df.groupBy(*by, c).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def split_cube(df: DataFrame, by: list[str], dims: list[str], aggs: list[Column], all_value: str = "ALL") -> DataFrame:
    """Every combination of a dimension's value or ALL that occurs: one expand, one aggregation."""
    sets = [[]]
    for d in dims:
        sets = [s + [d] for s in sets] + sets
    grouped = df.groupingSets([[F.col(c) for c in [*by, *s]] for s in sets], *[F.col(c) for c in [*by, *dims]])
    out = grouped.agg(*aggs, *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    return out.withColumns({d: F.when(F.col(f"_g_{d}") == 1, all_value).otherwise(F.col(d)) for d in dims}).drop(*[f"_g_{d}" for d in dims])


def overlapping_splits(df: DataFrame, splits: dict[str, Column], name: str = "split_id") -> DataFrame:
    """A row for every split whose condition holds."""
    held = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in splits.items()]))
    return df.withColumn(name, F.explode(held))


def pivot_wide(df: DataFrame, by: list[str], key: str, values: list, aggs: dict[str, Column]) -> DataFrame:
    """One column per value and aggregate, named value_aggregate; absent combinations are null."""
    wide = df.groupBy(*by).pivot(key, values).agg(*[c.alias(k) for k, c in aggs.items()])
    return wide if len(aggs) > 1 else wide.withColumnsRenamed({str(v): f"{v}_{next(iter(aggs))}" for v in values})


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n, n_null, null_share), one pass."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"c_{c}") for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c_{c}").alias("n_null")) for c in df.columns])
    return row.select("n", F.explode(cells).alias("x")).select("x.column", "n", "x.n_null", (F.col("x.n_null") / F.nullif(F.col("n"), F.lit(0))).alias("null_share"))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def shrunk_mean(df: DataFrame, by: list[str], x: str, k: float) -> DataFrame:
    """n / (n + k) of the group mean and the rest of the global mean."""
    total = df.agg(F.avg(x)).scalar()
    groups = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"))
    w = F.col("n") / (F.col("n") + k)
    return groups.withColumn("shrunk", w * F.coalesce("mean", F.lit(0.0)) + (1 - w) * total)


def any_value(c: str | Column) -> Column:
    """Some non-null value of a group; the smallest, so that reruns agree."""
    return F.min(c)


def first_present(c: str, order: str) -> Column:
    """First non-null value in order."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))


def last_present(c: str, order: str) -> Column:
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """z_<c> by the table's mean and population sd (null is 0, as is a flat column) and <c>_missing 0/1."""
    for c in cols:
        mean, sd = df.agg(F.avg(c)).scalar(), df.agg(F.stddev_pop(c)).scalar()
        z = F.when(F.col(c).isNull() | ~(sd > 1e-8), F.lit(0.0)).otherwise((F.col(c) - mean) / sd)
        df = df.withColumns({f"z_{c}": z, f"{c}_missing": F.col(c).isNull().cast("int")})
    return df


def evidence_fit(y: str, x: str, floor: float = 0.25) -> list[Column]:
    """a + b x with the population sd of what is left, at least `floor`; a flat x has slope 0."""
    flat = F.coalesce(F.var_pop(x) < 1e-8, F.lit(True))
    b = F.when(flat, 0.0).otherwise(F.covar_pop(x, y) / F.var_pop(x))
    left = F.when(flat, F.var_pop(y)).otherwise(F.var_pop(y) - F.pow(F.covar_pop(x, y), 2) / F.var_pop(x))
    return [(F.avg(y) - b * F.avg(x)).alias("a"), b.alias("b"), F.greatest(F.sqrt(F.greatest(left, F.lit(0.0))), F.lit(floor)).alias("sd")]


def ridge(df: DataFrame, features: list[str], y: str, l2: float = 1.0) -> DataFrame:
    """(term, coef, mean, sd) of a ridge fit on standardised features, the intercept free of the penalty.

    One aggregation of moments whose number depends on the features; rows with a null are left out.
    """
    import numpy as np

    cols = [F.col(c).cast("double") for c in [*features, y]]
    rows = df.select(*[c.alias(f"v{i}") for i, c in enumerate(cols)]).na.drop()
    k = len(features)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    got = rows.agg(F.count("*").alias("n"), *[F.avg(f"v{i}").alias(f"m{i}") for i in range(k + 1)], *[F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    if not got["n"]:
        raise ValueError("no complete rows")
    cov = np.zeros((k + 1, k + 1))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = got[f"c{i}_{j}"]
    sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    sd = np.where(sd > 1e-8, sd, 1.0)
    coef = np.linalg.solve(got["n"] * cov[:k, :k] / np.outer(sd, sd) + l2 * np.eye(k), got["n"] * cov[:k, k] / sd)
    out = [("intercept", float(got[f"m{k}"]), 0.0, 1.0), *((c, float(b), float(got[f"m{i}"]), float(s)) for i, (c, b, s) in enumerate(zip(features, coef, sd, strict=True)))]
    return df.sparkSession.createDataFrame(out, "term string, coef double, mean double, sd double")


def ridge_prediction(fit: list, terms: dict[str, Column]) -> Column:
    """The fitted value from collected rows of `ridge`."""
    return sum((r["coef"] * ((terms[r["term"]] - r["mean"]) / r["sd"] if r["term"] != "intercept" else F.lit(1.0)) for r in fit), F.lit(0.0))


def linear_fit(y: str, x: str) -> list[Column]:
    """Intercept, slope and residual sd (floored) of y on x."""
    n, both = F.regr_count(y, x), (F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), 2) / F.nullif(F.regr_sxx(y, x), F.lit(0.0)))
    return [F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"), F.greatest(F.sqrt(F.greatest(both, F.lit(0.0)) / F.nullif(n - 2, F.lit(0))), F.lit(1e-6)).alias("resid_sd")]


def wls_slope(x: Column, y: Column, w: Column) -> list[Column]:
    """Weighted slope and its standard error from moments."""
    ok = x.isNotNull() & y.isNotNull() & (w > 0)
    s = lambda e: F.sum(F.when(ok, e))
    sw, sx, sy, sxx, sxy, syy = s(w), s(w * x), s(w * y), s(w * x * x), s(w * x * y), s(w * y * y)
    d = sxx - sx * sx / sw
    slope = F.when(d > 1e-12, (sxy - sx * sy / sw) / d)
    rss = F.greatest(syy - sy * sy / sw - slope * (sxy - sx * sy / sw), F.lit(0.0))
    n = F.count_if(ok)
    return [slope.alias("slope"), F.when(n > 2, F.sqrt(rss / (n - 2) / d)).alias("slope_se"), n.alias("n")]


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Correlation of average ranks in each group, over rows with both values."""
    df = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b)

    def avg_rank(c: str) -> Column:
        # ties are counted in the order that ranks need anyway: one sort a column
        w = W.partitionBy(*by).orderBy(c)
        return F.rank().over(w) + (F.count("*").over(w.rangeBetween(W.currentRow, W.currentRow)) - 1) / 2

    return df.withColumns({"_ra": avg_rank(a), "_rb": avg_rank(b)}).groupBy(*by).agg(F.corr("_ra", "_rb").alias("spearman"))


def calibration(df: DataFrame, predicted: str, actual: str, by: list[str], k: int = 10) -> DataFrame:
    from fastbreak.operators.predicates import quantile_bins

    binned = quantile_bins(df, [F.col(predicted), F.col(actual)], k, "decile", tuple(by))
    return binned.groupBy(*by, "decile").agg(F.avg(predicted).alias("mean_predicted"), F.avg(actual).alias("mean_actual"), F.count("*").alias("n"))


def residual_slices(df: DataFrame, slice_col: str, resid: str) -> DataFrame:
    out = df.groupBy(slice_col).agg(F.count(resid).alias("n"), F.avg(resid).alias("mean"), F.stddev_samp(resid).alias("sd"), F.avg(F.abs(resid)).alias("mean_abs"))
    return out.withColumn("direction", F.when(F.col("mean") > 0, "over").when(F.col("mean") < 0, "under").otherwise("even"))


def regret(x: Column, beyond: float = 15) -> Column:
    return F.avg(F.when(x.isNotNull(), F.greatest(x - beyond, F.lit(0))))
