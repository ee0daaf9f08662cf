"""Filters, flags, bins and splits."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def whitelist(df: DataFrame, exact: list[str], prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Columns named or with a prefix, in the table's order."""
    return df.select([c for c in df.columns if c in exact or (prefixes and c.startswith(tuple(prefixes)))])


def drop_if_present(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def rename_if_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def first_existing(df: DataFrame, *names: str) -> Column:
    found = next((n for n in names if n in df.columns), None)
    if found is None:
        raise ValueError(f"none of {names} in {df.columns}")
    return F.col(found)


def any_present(*cols: Column) -> Column:
    return reduce(or_, (c.isNotNull() for c in cols))


def mask_then_fill(df: DataFrame, cols: list[str], fill: float = 0.0) -> DataFrame:
    """`<c>_missing` 0/1 beside each column, then the fill."""
    df = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in cols})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in cols})


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def cut(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins; the lowest edge belongs to the first."""
    out = F.when((c >= edges[0]) & (c <= edges[1]), labels[0])
    for lo, hi, name in zip(edges[1:], edges[2:], labels[1:], strict=False):
        out = out.when((c > lo) & (c <= hi), name)
    return out


def quantile_bins(df: DataFrame, order: list[Column], k: int, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """0-based bins of equal-width ranks: the bin of the r-th of n is ceil((r - 1) k / (n - 1)) - 1, 0 at least.

    A bin needs every row's rank, so without `by` the rows are ranked in one sorted pass.
    """
    n = F.count("*").over(W.partitionBy(*by))
    r = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    value = F.when(n == 1, 0).otherwise(F.greatest(F.ceil((r - 1) * k / F.nullif(n - 1, F.lit(0))) - 1, F.lit(0)))
    return df.withColumn(name, value.cast("int"))


def pick_bucket(pick: Column) -> Column:
    return F.when(pick.between(1, 14), "lottery").when(pick.between(15, 30), "late_first").when(pick.between(31, 60), "second").otherwise("undrafted")


def percent_rows(c: Column) -> Column:
    return F.when(c > 1, c / 100).otherwise(c)


def percent_column(df: DataFrame, c: str) -> DataFrame:
    """Divide the whole column by 100 if its largest value is over 1."""
    top = df.agg(F.max(c)).scalar()
    return df.withColumn(c, F.when(top > 1, F.col(c) / 100).otherwise(F.col(c)))


def qualified(games: Column, poss: Column, minutes: Column, min_games: int = 14, min_poss: float = 200, min_minutes: float = 400) -> Column:
    """struct(is_qualified, reason); the first failed rule names the reason."""
    reason = F.when(minutes.isNull(), "missing_minutes").when(games.isNull() | (games < min_games), "games").when(~((F.coalesce(poss, F.lit(0)) >= min_poss) | (minutes >= min_minutes)), "volume").otherwise("ok")
    return F.struct((reason == "ok").alias("is_qualified"), reason.alias("reason"))


def forbid(df: DataFrame, forbidden: set[str], prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Fails when a feature table holds target columns."""
    bad = sorted(c for c in df.columns if c in forbidden or c.startswith(tuple(prefixes) or "\0"))
    if bad:
        raise ValueError(f"forbidden columns: {bad}")
    return df


def walk_forward(df: DataFrame, year: str, test_year: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(up to test_year - 2, test_year - 1, test_year)."""
    y = F.col(year)
    return df.where(y <= test_year - 2), df.where(y == test_year - 1), df.where(y == test_year)


def stratified(df: DataFrame, by: list[str], most: int, total: int | None = None, seed: int = 0) -> DataFrame:
    """At most `most` rows of each stratum, then at most `total`, by a hash of the whole row."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns])
    out = df.withColumn("_h", h).withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("_h"))).where(F.col("_r") <= most)
    if total is not None:
        out = out.orderBy("_h").limit(total)
    return out.drop("_h", "_r")


OPS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: F.abs(a - b) < 0.001}


def stat_rule(c: Column, op: str, value: float) -> Column:
    """Null and NaN fail; an unknown operator passes."""
    if op not in OPS:
        return F.lit(True)
    v = c.cast("double")
    return F.coalesce(OPS[op](v, F.lit(float(value))) & ~F.isnan(v), F.lit(False))


def has_tokens(c: Column, query: str) -> Column:
    """Every word of the query is in the text."""
    tokens = query.lower().split()
    return reduce(and_, (F.lower(c).contains(t) for t in tokens), F.lit(True))


def experience_in(c: Column, wanted: str) -> Column:
    groups = {"FrSo": ["Fr", "So"], "JrSr": ["Jr", "Sr"]}
    return c.isin(groups.get(wanted, [wanted]))


def membership(pick: Column, listed: Column, wanted: str) -> Column:
    """`nba`: a pick or in the list; `drafted`: a pick; `undrafted`: in the list without one; `none`: neither; anything else passes."""
    has = pick.isNotNull() & ~F.trim(pick.cast("string")).isin("", "NA")
    known = F.coalesce(listed, F.lit(False))
    return {"nba": has | known, "none": ~(has | known), "drafted": has, "undrafted": known & ~has}.get(wanted, F.lit(True))


def within(ranges: dict[str, tuple[float | None, float | None]]) -> Column:
    """Every column inside its inclusive range; an open end is None, a null value fails a range that has an end."""
    conditions = [F.coalesce(op(F.col(c).cast("double"), v), F.lit(False)) for c, ends in ranges.items() for op, v in zip((lambda a, b: a >= b, lambda a, b: a <= b), ends, strict=True) if v is not None]
    return reduce(and_, conditions, F.lit(True))


def seasons_in(c: Column, include: list[int] | None = None, exclude: list[int] = ()) -> Column:
    kept = c.isin(list(include)) if include is not None else F.lit(True)
    return kept & ~c.isin(list(exclude)) if exclude else kept


def cohort(draft_year: Column, first: int, keep_unknown: bool = False) -> Column:
    """Drafted in `first` or later."""
    return F.coalesce(draft_year >= first, F.lit(keep_unknown))


def in_split(c: Column, wanted: str) -> Column:
    return F.coalesce(c, F.lit("ALL")) == wanted
