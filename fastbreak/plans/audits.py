"""Data-quality checks as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fastbreak.operators.aggregates import duplicate_keys, null_profile
from fastbreak.operators.joins import coverage


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(check, n, n_failed, passes): a rule is a condition that every row should meet; null fails. One pass."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c_{k}") for k, c in rules.items()])
    cells = F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"c_{k}").alias("n_failed")) for k in rules])
    return row.select("n", F.explode(cells).alias("x")).select("x.check", "n", "x.n_failed", (F.col("x.n_failed") == 0).alias("passes"))


def key_check(df: DataFrame, key: list[str]) -> DataFrame:
    return duplicate_keys(df, key).agg(F.count("*").alias("n_failed")).select(F.lit("unique_" + "_".join(key)).alias("check"), "n_failed", (F.col("n_failed") == 0).alias("passes"))


def coverage_gate(expected: DataFrame, present: DataFrame, on: list[str], least: float) -> DataFrame:
    flagged = coverage(expected, present, on)
    return flagged.agg(F.count("*").alias("expected"), F.sum("covered").alias("covered")).withColumn("rate", F.col("covered") / F.nullif(F.col("expected"), F.lit(0))).withColumn("passes", F.coalesce(F.col("rate") >= least, F.lit(False)))


def null_gate(df: DataFrame, most: dict[str, float]) -> DataFrame:
    """Columns whose share of nulls is over their limit."""
    prof = null_profile(df.select(*most))
    limit = F.element_at(F.create_map(*[x for k, v in most.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("column"))
    return prof.withColumn("limit", limit).withColumn("passes", F.col("null_share") <= F.col("limit"))


def all_pass(*tables: DataFrame) -> DataFrame:
    rows = reduce(lambda a, b: a.unionByName(b), [t.select("passes") for t in tables])
    return rows.agg(F.bool_and("passes").alias("passes"))


def repair_keys(df: DataFrame, key: list[str], median_cols: list[str], mode_cols: list[str], group: list[str]) -> DataFrame:
    """Fill nulls by the group's median or most frequent value (ties: the smallest), one row per key."""
    fill = df.groupBy(*group).agg(*[F.median(c).alias(f"_m_{c}") for c in median_cols], *[F.mode(c, deterministic=True).alias(f"_m_{c}") for c in mode_cols])
    out = df.join(fill, group, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in [*median_cols, *mode_cols]}).select(*df.columns)
    return out.dropDuplicates(key)
