"""Sorting, relevance and the leaderboard query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fastbreak.functions.rates import custom_stat
from fastbreak.operators.predicates import has_tokens, stat_rule

QUERY_BLOCK, ROW_BLOCK, MOST_BLOCKS = 256, 4096, 20_000


def mixed_sort(df: DataFrame, c: str, descending: bool, ties: list[Column]) -> DataFrame:
    """Empties last in both directions, numbers before texts."""
    text = F.col(c).cast("string")
    num = F.regexp_replace(text, "[,%$]", "").try_cast("double")
    empty = text.isNull() | (F.trim(text) == "")
    keys = [empty, num.isNull()] + ([num.desc(), F.lower(text).desc()] if descending else [num, F.lower(text)])
    return df.orderBy(*keys, *ties)


def relevance(name: Column, query: str, pick: Column | None = None, nba: Column | None = None, year: Column | None = None) -> Column:
    """1000 exact, 500 prefix, 300 start of a word; drafted +100, NBA +80, newer seasons first."""
    q, n = query.lower().strip(), F.lower(name)
    base = F.when(n == q, 1000).when(F.startswith(n, F.lit(q)), 500).when(F.contains(n, F.lit(" " + q)), 300).otherwise(0)
    extra = F.lit(0)
    if pick is not None:
        extra = extra + F.when(pick.isNotNull(), 100).otherwise(0)
    if nba is not None:
        extra = extra + F.when(nba, 80).otherwise(0)
    if year is not None:
        extra = extra + F.coalesce(year - 2000, F.lit(0))
    return base + extra


def search(df: DataFrame, c: str, query: str, score: Column, ties: list[Column], limit: int = 50) -> DataFrame:
    return df.where(has_tokens(F.col(c), query)).withColumn("score", score).orderBy(F.desc("score"), *ties).limit(limit)


def leaderboard(df: DataFrame, filters: list[Column] = (), rules: list[tuple[str, str, float]] = (), custom: dict[str, list[tuple[str, float, str]]] | None = None, sort: str | None = None, descending: bool = True, ties: list[Column] = (), limit: int | None = None) -> DataFrame:
    """Filters, custom stats, stat rules, mixed sort and a limit, composed into one plan."""
    for f in filters:
        df = df.where(f)
    for name, terms in (custom or {}).items():
        df = df.withColumn(name, custom_stat([(op, k, F.col(c)) for op, k, c in terms]))
    for c, op, v in rules:
        df = df.where(stat_rule(F.col(c), op, v))
    if sort:
        df = mixed_sort(df, sort, descending, list(ties))
    return df.limit(limit) if limit else df


def featured(df: DataFrame, boards: dict[str, Column], games: str, least_games: int, k: int, ties: list[Column]) -> DataFrame:
    """The first k rows of each named board (board, place, value, then the row), by its value downwards, among rows with enough games.

    Rows without a value are on no board. All boards are ranked in one pass over the rows that qualify.
    """
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("board"), v.cast("double").alias("value")) for n, v in boards.items()))).alias("_b")
    rows = df.where(F.col(games) >= least_games).select("*", each).where("_b.value IS NOT NULL AND NOT isnan(_b.value)")
    place = F.row_number().over(W.partitionBy("_b.board").orderBy(F.desc("_b.value"), *ties))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("_b.board", "place", "_b.value", *df.columns)


def rank_metrics(df: DataFrame, by: list[str], predicted: str, actual: str, k: int, ties: list[Column]) -> DataFrame:
    """Top-k hit rate and NDCG@k of each group, and precision and recall at k where a gain above 0 is relevant."""
    rp = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(predicted), *ties))
    ra = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(actual), *ties))
    r = df.withColumns({"_p": rp, "_a": ra})
    gain = lambda place: F.sum(F.when(F.col(place) <= k, F.greatest(F.col(actual), F.lit(0.0)) / F.log2(F.col(place) + 1)))
    return r.groupBy(*by).agg(
        (F.count_if((F.col("_p") <= k) & (F.col("_a") <= k)) / F.least(F.count("*"), F.lit(k))).alias("hit_rate"),
        (gain("_p") / F.nullif(gain("_a"), F.lit(0.0))).alias("ndcg"),
        (F.count_if((F.col("_p") <= k) & (F.col(actual) > 0)) / F.least(F.count("*"), F.lit(k))).alias("precision"),
        (F.count_if((F.col("_p") <= k) & (F.col(actual) > 0)) / F.nullif(F.count_if(F.col(actual) > 0), F.lit(0))).alias("recall"),
    )


def reachable(q: np.ndarray, boxes: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Places of the row blocks that may hold one of the k nearest of any query in a box.

    q: least and largest value of each feature; boxes: the same of each row block. Blocks taken by their
    largest distance hold k + 1 rows (a query may be one of them) within that of the last one needed;
    a block whose least distance is above it holds no neighbour.
    """
    gap = np.maximum(0, np.maximum(boxes[:, 0] - q[1], q[0] - boxes[:, 1]))
    span = np.maximum(boxes[:, 1] - q[0], q[1] - boxes[:, 0])
    least, most = np.sqrt((gap**2).sum(1)), np.sqrt((span**2).sum(1))
    order = np.argsort(most, kind="stable")
    enough = np.searchsorted(np.cumsum(sizes[order]), k + 1)
    bound = most[order[enough]] if enough < len(order) else np.inf
    return np.flatnonzero(least <= bound * (1 + 1e-9))


def nearest(queries: DataFrame, rows: DataFrame, id_: str, features: list[str], k: int) -> DataFrame:
    """k nearest rows of each query by Euclidean distance, of equal distances the smaller id first.

    Both sides may grow: they are sorted by their features and packed in blocks, of at most `QUERY_BLOCK`
    queries and of `ROW_BLOCK` rows (more only where that would make above `MOST_BLOCKS`). A block of
    queries meets the blocks of rows that the least and largest values of their features allow, and only
    the k nearest of each meeting are shuffled. Rows or queries with a missing feature have no distance
    and are left out, so are rows without an id. An id names one query and one row.
    """
    kind = rows.schema[id_].dataType.simpleString()
    names = [f"_f{i}" for i in range(len(features))]

    def packed(df: DataFrame, side: str, size: int) -> DataFrame:
        whole = df.where(F.col(id_).isNotNull()).select(id_, *[F.col(c).cast("double").alias(n) for c, n in zip(features, names, strict=True)]).na.drop(subset=names)
        whole = whole.repartitionByRange(*names, id_).sortWithinPartitions(*names, id_)
        # ids of rows rise from a multiple of 2^33 in each partition, so no block is larger
        ends = [F.array(*(f(n) for n in names)).alias(f"_{side}_{e}") for e, f in (("lo", F.min), ("hi", F.max))]
        return whole.groupBy(F.floor(F.monotonically_increasing_id() / size).alias(f"_{side}_b")).agg(F.array_sort(F.collect_list(F.struct(id_, *names))).alias(f"_{side}"), F.count("*").alias(f"_{side}_n"), *ends)

    size = max(ROW_BLOCK, -(-rows.count() // MOST_BLOCKS))
    # kept, as blocks are looked at twice and must be the same
    blocks = packed(rows, "r", size).persist(StorageLevel.MEMORY_AND_DISK)
    known = blocks.select("_r_b", "_r_n", "_r_lo", "_r_hi").toArrow()  # a line for each of a bounded number of blocks
    ids, sizes = known.column(0).to_numpy(), known.column(1).to_numpy()
    boxes = np.stack([np.array(known.column(i).to_pylist(), dtype=float).reshape(len(ids), len(names)) for i in (2, 3)], 1)
    held = rows.sparkSession.sparkContext.broadcast((ids, sizes, boxes))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, boxes = held.value
        for batch in batches:
            lo, hi = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_q_lo", "_q_hi"))
            found = [ids[reachable(np.array([a, b]), boxes, sizes, k)].tolist() for a, b in zip(lo, hi, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_q")), pa.array(found, pa.list_(pa.int64()))], names=["_q", "_to"])

    asked = packed(queries, "q", QUERY_BLOCK).select("_q", "_q_lo", "_q_hi")
    asked = asked.mapInArrow(meet, T.StructType([asked.schema["_q"], T.StructField("_to", T.ArrayType(T.LongType()))]))
    sides = asked.select("_q", F.explode("_to").alias("_r_b")).join(blocks.select("_r_b", "_r").hint("merge"), "_r_b").select("_q", "_r")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, r in zip(batch.column(0), batch.column(1), strict=True):
                (q_ids, *q_f), (r_ids, *r_f) = q.values.flatten(), r.values.flatten()
                square = np.zeros((len(q_ids), len(r_ids)))
                for x, y in zip(q_f, r_f, strict=True):
                    square += (x.to_numpy()[:, None] - y.to_numpy()[None, :]) ** 2
                d = np.sqrt(square)
                # a row with the query's own id is no neighbour
                at = {x: i for i, x in enumerate(q_ids.to_pylist())}
                for j, x in enumerate(r_ids.to_pylist()):
                    if x in at:
                        d[at[x], j] = np.nan
                best = np.argsort(d, axis=1, kind="stable")[:, :k]  # rows lie in the order of their ids; nan goes last
                near = np.take_along_axis(d, best, 1)
                i, j = np.nonzero(~np.isnan(near))
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(i)), r_ids.take(pa.array(best[i, j])), pa.array(near[i, j])], names=["q_id", id_, "distance"])

    both = sides.mapInArrow(compare, f"q_id {kind}, `{id_}` {kind}, distance double")
    near = W.partitionBy("q_id").orderBy("distance", id_)
    return both.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k).select("q_id", id_, "distance", (1 / (1 + F.col("distance"))).alias("similarity"), "place")
