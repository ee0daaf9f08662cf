"""Unions and deduplication with precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union_all(*dfs: DataFrame) -> DataFrame:
    """By name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def first_source_wins(dfs: list[DataFrame], key: list[str], ties: list[Column]) -> DataFrame:
    """Union in order of precedence, one row per key."""
    parts = [d.withColumn("_p", F.lit(i)) for i, d in enumerate(dfs)]
    return dedupe(union_all(*parts), key, [F.col("_p"), *ties]).drop("_p")


def dedupe(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def most_complete(df: DataFrame, key: list[str], ties: list[Column], weights: dict[str, float] | None = None) -> DataFrame:
    """The row with most (weighted) non-null columns."""
    cols = [c for c in df.columns if c not in key]
    filled = sum((F.col(c).isNotNull().cast("double") * (weights or {}).get(c, 1.0) for c in cols), F.lit(0.0))
    return dedupe(df.withColumn("_c", filled), key, [F.desc("_c"), *ties]).drop("_c")


def unpivot_sides(df: DataFrame, sides: dict[str, dict[str, str]], keep: list[str], name: str = "side") -> DataFrame:
    """One scan: a row per side with its columns renamed alike."""
    rows = F.array(*[F.struct(F.lit(s).alias(name), *[F.col(src).alias(dst) for dst, src in cols.items()]) for s, cols in sides.items()])
    return df.select(*keep, F.explode(rows).alias("_s")).select(*keep, "_s.*")


def keys_in_both(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.select(*key).intersect(b.select(*key))


def keys_only_in(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.select(*key).distinct().join(b.select(*key).distinct(), key, "left_anti")
