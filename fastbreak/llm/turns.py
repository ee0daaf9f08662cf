"""Positions in ordered groups, dense names and digests of ordered groups, whatever the size of a group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fastbreak.llm.common import materialize


def part(c: str) -> Column:
    """The partition that a monotonically increasing id was given in."""
    return F.shiftright(c, 33)


def numbered(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """`rows` with pos, the place (from 0) of a row among those of its key; written to the shared folder.

    Keys are not null. Rows are sorted over all partitions at once, so the rows of a large key lie in
    many of them; equal rows are told apart by a random number, as any order of them will do. Only the
    keys that lie in two partitions or more, at most one for each border, need an offset from elsewhere
    and are broadcast.
    """
    by = [F.col(key), *order, F.col("_tie")]
    placed = rows.withColumn("_tie", F.rand(0)).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    placed = materialize(placed.drop("_tie"), "placed").withColumn("_part", part("_id"))
    parts = placed.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")
    late = parts.withColumn("_before", before).where("_before > 0").drop("_n")
    here = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_id")) - 1
    return materialize(placed.withColumn("_here", here).join(F.broadcast(late), [key, "_part"], "left").withColumn("pos", F.col("_here") + F.coalesce("_before", F.lit(0))).drop("_id", "_part", "_here", "_before"), "numbered")


def dense_names(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`rows` with a number for each distinct combination of `keys` (none null), from 0 without gaps; written."""
    distinct = materialize(rows.select(*keys).distinct().withColumn("_id", F.monotonically_increasing_id()), "distinct").withColumn("_part", part("_id"))
    # one row for each partition of the table of names
    counts = distinct.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"))
    names = materialize(distinct.join(F.broadcast(offsets), "_part").select(*keys, (F.col("_id") + F.col("_shift")).alias(name)), "names")
    return materialize(rows.join(names, keys), "named")


def digests(rows: DataFrame, keys: list[str], order: list[str], value: str, between: str, name: str) -> DataFrame:
    """Per key the SHA-256 of its values, in order and joined by `between`; values that are null are passed over.

    The digest of a sequence can only be taken in its order, so the values of a key go through one
    task; they pass as a stream behind a sort that spills, and no more than a batch is held.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema), f"{name} string"])
    glue = between.encode()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, first = None, None, True
        for batch in batches:
            done = []
            for *key, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state, first = key, hashlib.sha256(), True
                if v is not None:
                    state.update(v.encode() if first else glue + v.encode())
                    first = False
            if done:
                yield packed(done)
        if now is not None:
            yield packed([(*now, state.hexdigest())])

    def packed(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=[*keys, name])

    types = [{"bigint": pa.int64(), "string": pa.string()}[t] for _, t in rows.select(*keys).dtypes] + [pa.string()]
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, value).mapInArrow(stream, schema)


def crc_sql(text: str) -> str:
    """DuckDB: the unsigned crc32 of an ASCII string expression, by the bits of its polynomial."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [256 + ord(c), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))"
    step = "CASE WHEN b >= 256 THEN xor(a, b - 256) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda a, b: {step}), 4294967295)"
