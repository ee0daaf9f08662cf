"""Shared helpers: tables, the shared scratch folder, word splitting, skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: White space that separates words: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only where none is set, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="fastbreak-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/fastbreak/{name}-{uuid.uuid4().hex}"


#: Paths of the tables made in the innermost `scratch` block.
_MADE: ContextVar[list | None] = ContextVar("made", default=None)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession, left: list[str] | None = None) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables materialized inside at the end, but for those passed to what it yields.

    Whatever leaves the block must be read from a table that was kept. With `left` nothing is deleted
    and the paths are appended to it, for a caller that deletes them once their readers are written.
    """
    outer, made, kept = _MADE.get(), [], set()
    token = _MADE.set(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.scratch)
        return df

    try:
        yield keep
    finally:
        _MADE.reset(token)
        if left is not None:
            left += made
        else:
            for path in made:
                if path not in kept:
                    remove(spark, path)
            if outer is not None:
                outer += kept


def other_columns_aside(*needed: str):
    """For functions that return rows of their first argument: its other columns have neutral names meanwhile, so none can clash."""

    def wrap(f):
        @wraps(f)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            named = [c if c in needed else f"_a{i}" for i, c in enumerate(docs.columns)]
            return f(docs.toDF(*named), *args, **kwargs).select(*named).toDF(*docs.columns)

        return run

    return wrap


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of the maximal runs of non-white-space; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def crc_mod(c: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def lookup(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Left join to a table with one row per key.

    The right side is written first, so both sides of the join are plain exchanges and Spark can
    split a partition of the left side that a hot key fills.
    """
    return left.join(materialize(right, name), key, "left")


#: Up to so many keys (of a digest's size each) a side may be broadcast; beyond that both sides are shuffled.
FEW_KEYS = 1_000_000


def few(keys: DataFrame) -> bool:
    return keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS


def with_keys(left: DataFrame, keys: DataFrame, on: list[str], anti: bool = False) -> DataFrame:
    """The rows of `left` whose key is (with `anti`: is not) in `keys`, a written table.

    Texts on the left stay where they are while the keys are few.
    """
    return left.join(F.broadcast(keys) if few(keys) else keys, on, "left_anti" if anti else "left_semi")
