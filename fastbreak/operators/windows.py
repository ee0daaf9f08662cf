"""Ordered analytics. Every order is total: callers give ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_one(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, by, order, 1)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def average_rank(by: list[str], c: str, descending: bool = False) -> Column:
    """Mean of the places that ties share."""
    order = F.col(c).desc() if descending else F.col(c).asc()
    return F.rank().over(W.partitionBy(*by).orderBy(order)) + (F.count("*").over(W.partitionBy(*by, c)) - 1) / 2


def value_ranks(df: DataFrame, by: list[str], c: str, descending: bool = False) -> DataFrame:
    """Each group's values with rank, dense_rank and average_rank, from their counts: few rows where values repeat."""
    order = W.partitionBy(*by).orderBy(F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first())
    n = df.groupBy(*by, c).agg(F.count("*").alias("_n"))
    n = n.withColumns({"rank": F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n") + 1, "dense_rank": F.row_number().over(order)})
    return n.withColumn("average_rank", F.col("rank") + (F.col("_n") - 1) / 2).drop("_n")


def rank_within(by: list[str], order: list[Column], flag: Column) -> Column:
    """Place among the rows with the flag; null for the others."""
    return F.when(flag, F.row_number().over(W.partitionBy(*by, flag).orderBy(*order)))


def sessionize(df: DataFrame, by: list[str], order: list[Column], changed: Column, name: str = "session") -> DataFrame:
    """1-based session number: a new one wherever `changed` holds (it may use lag over by and order)."""
    w = W.partitionBy(*by).orderBy(*order)
    flag = F.coalesce(changed.cast("int"), F.lit(0))
    return df.withColumn("_f", flag).withColumn(name, F.sum("_f").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.lit(1)).drop("_f")


def changed(c: Column, by: list[str], order: list[Column]) -> Column:
    """The value differs from the row before; false on the first row."""
    w = W.partitionBy(*by).orderBy(*order)
    return (F.row_number().over(w) > 1) & ~c.eqNullSafe(F.lag(c).over(w))


def periods(df: DataFrame, by: list[str], order: list[Column], remaining: str, rise: float = 60) -> DataFrame:
    """Period number: the clock rising by more than `rise` seconds starts a new one."""
    w = W.partitionBy(*by).orderBy(*order)
    return sessionize(df, by, order, F.col(remaining) - F.lag(remaining).over(w) > rise, "period")


def rolling_long(df: DataFrame, by: list[str], order: list[Column], sums: list[str], ratios: dict[str, tuple[str, str]], sizes: tuple[int, ...] = (5, 10, 15)) -> DataFrame:
    """One row per input row and window (last5, ..., season): sums over the frame and ratios of sums."""
    base = W.partitionBy(*by).orderBy(*order)
    frames = {f"last{n}": base.rowsBetween(-n + 1, 0) for n in sizes} | {"season": base.rowsBetween(W.unboundedPreceding, 0)}
    cells = [F.struct(F.lit(k).alias("window_id"), F.count("*").over(f).alias("n_games"), *[F.sum(c).over(f).alias(c) for c in sums]) for k, f in frames.items()]
    out = df.withColumn("_w", F.array(*cells)).drop(*sums).select("*", F.explode("_w").alias("_x")).drop("_w").select("*", "_x.*").drop("_x")
    return out.withColumns({k: F.when(F.col(d) > 0, F.col(n) / F.col(d)) for k, (n, d) in ratios.items()})


def rolling_weighted(df: DataFrame, by: list[str], order: list[Column], weight: str, means: list[str], sums: list[str] = (), sizes: tuple[int, ...] = (10,)) -> DataFrame:
    """One row per input row and window (last10, ..., season): sums, and means weighted by `weight`.

    Missing values add nothing to a mean's numerator while their weight counts, missing weights count 0;
    a window whose weights do not sum above 0 has no mean.
    """
    base = W.partitionBy(*by).orderBy(*order)
    frames = {f"last{n}": base.rowsBetween(-n + 1, 0) for n in sizes} | {"season": base.rowsBetween(W.unboundedPreceding, 0)}
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    mean = lambda c, f: F.when(F.sum(w).over(f) > 0, F.sum(zero(c) * w).over(f) / F.sum(w).over(f))
    cells = [F.struct(F.lit(k).alias("window_id"), F.count("*").over(f).alias("n_games"), *[F.sum(zero(c)).over(f).alias(c) for c in sums], *[mean(c, f).alias(c) for c in means]) for k, f in frames.items()]
    return df.withColumn("_w", F.array(*cells)).drop(*sums, *means).select("*", F.explode("_w").alias("_x")).drop("_w").select("*", "_x.*").drop("_x")


def rolling_mean(by: list[str], order: list[Column], c: str, n: int, least: int | None = None) -> Column:
    f = W.partitionBy(*by).orderBy(*order).rowsBetween(-n + 1, 0)
    return F.when(F.count(c).over(f) >= (least or n), F.avg(c).over(f))


def last_n_totals(df: DataFrame, by: list[str], order: list[Column], sums: list[str], n: int) -> DataFrame:
    """Totals of the last n games and of the n before; null where there are fewer."""
    back = W.partitionBy(*by).orderBy(*[o.desc() for o in order])
    r = df.withColumn("_r", F.row_number().over(back))
    aggs = []
    for c in sums:
        last, prev = F.col("_r") <= n, (F.col("_r") > n) & (F.col("_r") <= 2 * n)
        aggs += [F.when(F.count_if(last) == n, F.sum(F.when(last, F.col(c)))).alias(f"{c}_last{n}"), F.when(F.count_if(prev) == n, F.sum(F.when(prev, F.col(c)))).alias(f"{c}_prev{n}")]
    return r.groupBy(*by).agg(*aggs)


def peak(df: DataFrame, by: list[str], season: str, c: str) -> DataFrame:
    """Best rolling mean over 3, else 2, else 1 seasons, with its last season."""
    w = W.partitionBy(*by).orderBy(season)
    for k in (1, 2, 3):
        f = w.rowsBetween(-k + 1, 0)
        df = df.withColumn(f"_m{k}", F.when(F.count(c).over(f) == k, F.avg(c).over(f)))
    aggs = []
    for k in (1, 2, 3):
        best = F.max(F.when(F.col(f"_m{k}").isNotNull(), F.struct(F.col(f"_m{k}"), -F.col(season))))
        aggs.append(best.alias(f"_b{k}"))
    out = df.groupBy(*by).agg(*aggs)
    pick = F.coalesce(*[F.when(F.col(f"_b{k}").isNotNull(), F.struct(F.col(f"_b{k}._m{k}").alias("peak"), (-F.col(f"_b{k}.col2")).alias("peak_end"), F.lit(k).alias("peak_seasons"))) for k in (3, 2, 1)])
    return out.select(*by, pick.alias("p")).select(*by, "p.*")


def zscore(c: Column, by: list[str], degenerate: float = 0.0) -> Column:
    """Sample sd in each group; a flat group gives 0."""
    w = W.partitionBy(*by)
    sd = F.stddev_samp(c).over(w)
    return F.when(c.isNull(), None).when(sd > degenerate, (c - F.avg(c).over(w)) / sd).otherwise(0.0)


def zscore_filled(c: Column, by: list[str], limit: float = 3.0) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.coalesce(zscore(c, by), F.lit(0.0))))


def residual(c: Column, by: list[str]) -> Column:
    return c - F.avg(c).over(W.partitionBy(*by))


def share(c: Column, by: list[str]) -> Column:
    total = F.sum(c).over(W.partitionBy(*by))
    return F.when(total != 0, c / total)


def trailing_slope(df: DataFrame, by: list[str], season: str, c: str, n: int = 3, name: str = "slope") -> DataFrame:
    """Slope over the last n non-null rows as of each row; null with fewer."""
    some = df.where(F.col(c).isNotNull())
    f = W.partitionBy(*by).orderBy(season).rowsBetween(-n + 1, 0)
    slope = F.regr_slope(F.col(c).cast("double"), F.col(season).cast("double")).over(f)
    return some.withColumn(name, F.when(F.count("*").over(f) == n, slope))


def consecutive_changes(df: DataFrame, by: list[str], order: list[Column], c: str, carry: list[str]) -> DataFrame:
    """A row where c differs from the row before: old and new value, carried columns of both sides."""
    w = W.partitionBy(*by).orderBy(*order)
    out = df.withColumns({f"prev_{x}": F.lag(x).over(w) for x in [c, *carry]})
    return out.where(F.col(f"prev_{c}").isNotNull() & (F.col(f"prev_{c}") != F.col(c)))
