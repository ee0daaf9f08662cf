"""Transforms fitted on one set of rows and applied to any: era z-scores, team residuals, filled values.

What is fitted is a table (statistics per group), so it can be kept in a catalog and applied to rows that
come later. Fitting is one aggregation per table with partial sums before the shuffle; applying is a
join with one row per group, so a group that holds many rows is not gathered anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fastbreak.sources.catalog import Catalog

#: Kept statistics: which column, at which level of keys, and the keys' values as texts.
STATS = ("feature", "level", "k", "n", "mean", "sd")


def _value(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


def _key(keys: list[str]) -> Column:
    return F.array(*(F.col(c).cast("string") for c in keys)) if keys else F.array().cast("array<string>")


def fit_groups(df: DataFrame, features: list[str], levels: list[list[str]]) -> DataFrame:
    """One row per feature, level and group: count, mean and sample sd of its values; nulls and NaN count as missing.

    A level is a list of key columns, the empty one stands for all rows. Groups with a null key are left out.
    """
    out = []
    for i, keys in enumerate(levels):
        rows = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in keys), F.lit(True)))
        wide = rows.groupBy(_key(keys).alias("k")).agg(*(x for j, c in enumerate(features) for x in (F.count(_value(c)).alias(f"n{j}"), F.avg(_value(c)).alias(f"m{j}"), F.stddev_samp(_value(c)).alias(f"s{j}"))))
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"n{j}").alias("n"), F.col(f"m{j}").alias("mean"), F.col(f"s{j}").alias("sd")) for j, c in enumerate(features)))).alias("x")
        out.append(wide.select("k", each).select("x.feature", F.lit(i).alias("level"), "k", "x.n", "x.mean", "x.sd").where("n > 0"))
    return reduce(DataFrame.unionByName, out)


def with_groups(df: DataFrame, stats: DataFrame, features: list[str], level: int, keys: list[str], tag: str) -> DataFrame:
    """`df` with struct columns <tag>_<feature> of its group's n, mean and sd at a level; null where the group was not fitted."""
    own = stats.where((F.col("level") == level) & F.col("feature").isin(*features)).groupBy("k")
    wide = own.agg(*(F.max(F.when(F.col("feature") == c, F.struct("n", "mean", "sd"))).alias(f"{tag}_{c}") for c in features))
    return df.withColumn("_k", _key(keys)).join(wide.withColumnRenamed("k", "_k"), "_k", "left").drop("_k")


def apply_era(df: DataFrame, stats: DataFrame, features: list[str], era: str) -> DataFrame:
    """<feature>_z: distance from the era's mean in its sds (1 where that is 0), by level 0 of the statistics.

    Eras that were not fitted, or with a single value, take the statistics of all rows (level 1).
    """
    out = with_groups(with_groups(df, stats, features, 0, [era], "_e"), stats, features, 1, [], "_a")
    for c in features:
        own = F.col(f"_e_{c}.sd").isNotNull()
        mean, sd = (F.when(own, F.col(f"_e_{c}.{x}")).otherwise(F.col(f"_a_{c}.{x}")) for x in ("mean", "sd"))
        out = out.withColumn(f"{c}_z", (_value(c) - mean) / F.when(sd == 0, 1.0).otherwise(sd))
    return out.drop(*(f"{t}_{c}" for t in ("_e", "_a") for c in features))


def apply_team(df: DataFrame, stats: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """<feature>_resid: difference from the mean of the team's season; null where that was not fitted."""
    out = with_groups(df, stats, features, 0, keys, "_t")
    return out.withColumns({f"{c}_resid": _value(c) - F.col(f"_t_{c}.mean") for c in features}).drop(*(f"_t_{c}" for c in features))


def apply_fill(df: DataFrame, stats: DataFrame, features: list[str], levels: list[list[str]], least: int = 1) -> DataFrame:
    """<feature>_filled, <feature>_sd and <feature>_source of each feature.

    A value that is there is `measured`, with sd 0. A missing one is the mean of the first level's group
    with at least `least` values, `imputed:<level number>`, with that group's sd; without one it is
    `missing`, with nulls.
    """
    out = df
    for i, keys in enumerate(levels):
        out = with_groups(out, stats, features, i, keys, f"_f{i}")
    for c in features:
        v = _value(c)
        found = [F.when(F.col(f"_f{i}_{c}.n") >= least, F.struct(F.col(f"_f{i}_{c}.mean").alias("mean"), F.col(f"_f{i}_{c}.sd").alias("sd"), F.lit(f"imputed:{i}").alias("source"))) for i in range(len(levels))]
        best = F.coalesce(*found)
        out = out.withColumns({
            f"{c}_filled": F.coalesce(v, best["mean"]), f"{c}_sd": F.when(v.isNotNull(), 0.0).otherwise(best["sd"]),
            f"{c}_source": F.when(v.isNotNull(), "measured").otherwise(F.coalesce(best["source"], F.lit("missing"))),
        })
    return out.drop(*(f"_f{i}_{c}" for i in range(len(levels)) for c in features))


def combined(df: DataFrame, measured: str, imputed: str, sd: str, name: str) -> DataFrame:
    """<name>, <name>_uncertainty and <name>_source of a measured column and one that a model filled."""
    m, i = _value(measured), _value(imputed)
    source = F.when(m.isNotNull(), "measured").when(i.isNotNull(), "imputed").otherwise("missing")
    return df.withColumns({name: F.coalesce(m, i), f"{name}_uncertainty": F.when(m.isNotNull(), 0.0).otherwise(_value(sd)), f"{name}_source": source})


@dataclass
class Transforms:
    """Fitted tables and the columns they were fitted for."""

    era: str
    team: list[str]
    fill: list[list[str]]
    drifting: list[str]
    contextual: list[str]
    sparse: list[str]
    least: int = 1
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Transforms:
        """Statistics of `df` for all three transforms."""
        if self.drifting:
            self.tables["era"] = fit_groups(df, self.drifting, [[self.era], []])
        if self.contextual:
            self.tables["team"] = fit_groups(df, self.contextual, [self.team])
        if self.sparse:
            self.tables["fill"] = fit_groups(df, self.sparse, self.fill)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        """`df` with the columns of all transforms that were fitted; rows and their number stay."""
        if "era" in self.tables:
            df = apply_era(df, self.tables["era"], self.drifting, self.era)
        if "team" in self.tables:
            df = apply_team(df, self.tables["team"], self.contextual, self.team)
        if "fill" in self.tables:
            df = apply_fill(df, self.tables["fill"], self.sparse, self.fill, self.least)
        return df

    def save(self, catalog: Catalog, name: str) -> None:
        for part, table in self.tables.items():
            catalog.write(f"{name}_{part}", table.select(*STATS))

    def load(self, catalog: Catalog, name: str) -> Transforms:
        self.tables = {part: catalog.table(f"{name}_{part}") for part in ("era", "team", "fill") if catalog.exists(f"{name}_{part}")}
        return self
