"""Readers and writers of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fastbreak.functions.clock import year_in_name


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, header: bool = True) -> DataFrame:
    """Quoted fields with doubled quotes; an explicit schema spares a pass over the data."""
    r = spark.read.option("header", header).option("escape", '"').option("mode", "PERMISSIVE")
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def read_season_files(spark: SparkSession, path_glob: str, schema: str | None = None, season: str = "season") -> DataFrame:
    """Files of many seasons, the season read from the file's name; a folder that Spark wrote counts as one file of its name."""
    last, folder = F.substring_index(F.input_file_name(), "/", -1), F.substring_index(F.substring_index(F.input_file_name(), "/", -2), "/", 1)
    return read_csv(spark, path_glob, schema).withColumn(season, year_in_name(F.when(last.startswith("part-"), folder).otherwise(last)))


def read_tree(spark: SparkSession, root: str, pattern: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("header", True).option("escape", '"')
    return r.schema(schema).csv(root) if schema else r.option("inferSchema", True).csv(root)


def read_json_rows(spark: SparkSession, path: str, rows: str = "rows") -> DataFrame:
    """An array of objects, or an object that holds one under `rows`."""
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode(rows).alias("_r")).select("_r.*") if rows in df.columns else df


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Structs to columns, all levels."""
    while nested := [f.name for f in df.schema if isinstance(f.dataType, T.StructType)]:
        cols = []
        for f in df.schema:
            cols += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{sep}{g.name}") for g in f.dataType] if f.name in nested else [F.col(f"`{f.name}`")]
        df = df.select(*cols)
    return df


def parse_csv_line(c, schema: str):
    return F.from_csv(c, schema, {"escape": '"'})


def write_partitioned(df: DataFrame, path: str, by: str, keys: list[str], fmt: str = "json") -> DataFrame:
    """Partitioned files and their manifest: one row per partition with its path, match keys, columns and rows."""
    df.write.mode("overwrite").partitionBy(by).format(fmt).save(path)
    counts = df.groupBy(by).agg(F.count("*").alias("rows"))
    return counts.select(by, F.concat(F.lit(f"{path}/{by}="), F.col(by).cast("string")).alias("url"), F.array(*map(F.lit, keys)).alias("match_keys"), F.array(*map(F.lit, df.columns)).alias("columns"), "rows")


def dataset_for(manifest: DataFrame, by: str, value) -> DataFrame:
    return manifest.where(F.col(by) == value)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
