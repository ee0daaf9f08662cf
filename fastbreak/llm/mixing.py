"""Mixing sources to target weights by fixed-length blocks.

1. Every source's documents form one token stream (ordered by a hash bucket of the id, then id);
   the stream is packed into blocks of `block` words, so a block holds pieces of documents.
2. Targets: sources by code point, null last, weigh 1, 2, 3, 1, ...; they share all words, no source
   above `max_repeat` times its size, the excess shared again by weight.
3. Output shards hold `shard_slots` slots. Every shard draws its source counts from a multinomial
   seeded by the shard's number. Running counts number a source's slots over all shards; slots beyond
   what a source owes are handed to the sources that were drawn too rarely, in order.
4. Slot j of a source maps to a block by a pseudorandom permutation (a keyed Feistel network, walked
   until it lands in range) of the block numbers, a fresh one for each pass over the source. Each
   pass takes each block once. The last slot of a source takes only the words it still owes.
5. Slots join pieces on (source, block number).

Defined cases: a null text has no words; a null source is a source of its own, last; documents
without words take nothing; repeated rows are separate documents; an empty table gives an empty mix;
extra columns are not read. A rerun gives the same mix.

Scale: texts are read once for their word counts and never shuffled. Stream offsets come from two
levels (a fixed number of hash buckets per source, then a window inside a bucket), so a source with
a third of all rows is spread out. A source's slots are numbered in two levels as well (ranges of
`SHARD_RANGE` shards, then inside a range) and made shard by shard, so no task makes all slots of a
source. The source list is collected, up to `MAX_SOURCES` rows; more
raise an error rather than outgrow the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fastbreak.llm.common import materialize, scratch

BLOCK = 256
SHARD_SLOTS = 4096
SHARD_RANGE = 1024
BUCKETS = 4096
MAX_REPEAT = 3
MAX_SOURCES = 200_000
SEED = 17
ROUNDS = 4


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def round_keys(seed: int, source: int, epoch: int) -> np.ndarray:
    digest = hashlib.sha256(f"{seed}/{source}/{epoch}".encode()).digest()
    return np.frombuffer(digest, dtype="<u8")[:ROUNDS]


def permute(i: np.ndarray, n: int, keys: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A permutation of range(n): Feistel rounds on the next even number of bits, walked into range."""
    half = np.uint64(max(1, math.ceil(max(1, (n - 1).bit_length()) / 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = i.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        x = out[todo]
        left, right = x >> half, x & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix64(left + k) & mask), left
            else:
                left, right = right, left ^ (mix64(right + k) & mask)
        out[todo] = (left << half) | right
        todo[todo] = out[todo] >= n
    return out.astype(np.int64)


def water_fill(sizes: list[int], max_repeat: int = MAX_REPEAT) -> list[float]:
    """Targets of the sources in order: weights 1, 2, 3, ... share the total, capped and reshared."""
    weights = [1 + i % 3 for i in range(len(sizes))]
    targets, capped, left = [0.0] * len(sizes), set(), float(sum(sizes))
    while len(capped) < len(sizes):
        share = left / sum(w for i, w in enumerate(weights) if i not in capped)
        over = [i for i, w in enumerate(weights) if i not in capped and share * w > max_repeat * sizes[i]]
        if not over:
            for i, w in enumerate(weights):
                if i not in capped:
                    targets[i] = share * w
            break
        for i in over:
            targets[i] = float(max_repeat * sizes[i])
            left -= targets[i]
            capped.add(i)
    return targets


def quota(size: int, target: float, block: int, seed: int, source: int, max_repeat: int) -> dict:
    """Blocks of a source, the slots that hold its target, and the words its last slot takes."""
    blocks = -(-size // block)
    if not size:
        return {"blocks": 0, "slots": 0, "trim": block}
    owed = min(round(target), max_repeat * size)
    epochs, rest = divmod(owed, size)
    if not rest:
        return {"blocks": blocks, "slots": epochs * blocks, "trim": block}
    tail = size - (blocks - 1) * block
    at = int(permute(np.array([blocks - 1]), blocks, round_keys(seed, source, epochs), inverse=True)[0])
    n = -(-rest // block)
    if n > at:  # the short last block is among them
        n = max(at + 1, 1 + -(-(rest - tail) // block))
    before = (n - 1) * block if n - 1 <= at else (n - 2) * block + tail
    return {"blocks": blocks, "slots": epochs * blocks + n, "trim": rest - before}


def source_key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def stream(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Per document its size and its first word's place in its source's stream. Written once."""
    sized = docs.select(
        "doc_id",
        "source",
        source_key(F.col("source")).alias("sk"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("size"),
        F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"),
    )
    with scratch(docs.sparkSession) as keep:
        sized = materialize(sized, "sizes")
        totals = sized.groupBy("sk", "bucket").agg(F.sum("size").alias("n"))
        before = W.partitionBy("sk").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        base = totals.select("sk", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        inside = W.partitionBy("sk", "bucket").orderBy("doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
        placed = sized.join(base.hint("merge"), ["sk", "bucket"]).withColumn("first", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        return keep(materialize(placed.select("doc_id", "source", "sk", "size", "first"), "stream"))


def targets(spark: SparkSession, placed: DataFrame, block: int, max_repeat: int, seed: int) -> list[dict]:
    """One dict per source, in order."""
    rows = placed.groupBy("sk").agg(F.sum("size").alias("size"), F.first("source").alias("source")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    filled = water_fill([r["size"] for r in rows], max_repeat)
    return [{"src": i, "sk": r["sk"], "source": r["source"], "size": r["size"], "target": t} | quota(r["size"], t, block, seed, i, max_repeat) for i, (r, t) in enumerate(zip(rows, filled, strict=True))]


def slots(spark: SparkSession, plan: list[dict], shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, src, block, trim) of the mix."""
    owed = np.array([p["slots"] for p in plan], dtype=np.int64)
    total = int(owed.sum())
    shards = -(-total // shard_slots)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for shard in pdf["id"]:
                n = min(shard_slots, total - shard * shard_slots)
                counts = np.random.default_rng([seed, shard]).multinomial(n, owed / total)
                src = np.flatnonzero(counts)
                ends = np.cumsum(counts[src])
                out.append(pd.DataFrame({"shard": shard, "src": src, "n": counts[src], "slot": ends - counts[src]}))
            if out:
                yield pd.concat(out)

    drawn = materialize(spark.range(shards).mapInPandas(draw, "shard bigint, src bigint, n bigint, slot bigint"), "draws")
    made = np.zeros(len(plan), dtype=np.int64)
    for r in drawn.groupBy("src").agg(F.sum("n").alias("n")).collect():
        made[r["src"]] = r["n"]
    surplus, lack = np.maximum(made - owed, 0), np.maximum(owed - made, 0)
    surplus_at, lack_ends = np.cumsum(surplus) - surplus, np.cumsum(lack)
    blocks, trims = np.array([p["blocks"] for p in plan], dtype=np.int64), np.array([p["trim"] for p in plan], dtype=np.int64)
    ranged = drawn.withColumn("range", F.floor(F.col("shard") / SHARD_RANGE))
    before = W.partitionBy("src").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    base = ranged.groupBy("src", "range").agg(F.sum("n").alias("m")).select("src", "range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("src", "range").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    runs = ranged.join(base.hint("merge"), ["src", "range"]).withColumn("j", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    each = runs.select("shard", "src", "slot", "j", "n").repartition("shard").select("shard", "src", "slot", "j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    each = each.select("shard", "src", (F.col("slot") + F.col("i")).alias("slot"), (F.col("j") + F.col("i")).alias("j"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            src, j = pdf["src"].to_numpy().copy(), pdf["j"].to_numpy().copy()
            over = np.flatnonzero(j >= owed[src])
            spare = surplus_at[src[over]] + j[over] - owed[src[over]]
            to = np.searchsorted(lack_ends, spare, side="right")
            src[over] = to
            j[over] = made[to] + spare - (lack_ends[to] - lack[to])
            block, epoch = np.zeros(len(j), dtype=np.int64), j // np.maximum(blocks[src], 1)
            for s, e in sorted(set(zip(src.tolist(), epoch.tolist(), strict=True))):
                own = np.flatnonzero((src == s) & (epoch == e))
                block[own] = permute(j[own] % blocks[s], int(blocks[s]), round_keys(seed, s, e))
            trim = np.where(j == owed[src] - 1, trims[src], np.iinfo(np.int64).max)
            yield pd.DataFrame({"shard": pdf["shard"], "slot": pdf["slot"], "src": src, "block": block, "trim": trim})

    return each.mapInPandas(place, "shard bigint, slot bigint, src bigint, block bigint, trim bigint")


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sources, pieces).

    sources: source, source_size, target. pieces: one row per document and block it lies in, and per
    slot that takes the block: doc_id, source, size, source_size, target, first (the document's place
    in its source's stream), word_from, word_to (of the document, end exclusive), shard, slot; the
    last four are null where no slot takes that piece.
    """
    spark = docs.sparkSession
    placed = stream(docs)
    plan = targets(spark, placed, block, max_repeat, seed)
    sources = spark.createDataFrame([(p["src"], p["sk"], p["source"], p["size"], p["target"]) for p in plan], "src bigint, sk string, source string, source_size bigint, target double")
    known = placed.join(F.broadcast(sources.drop("source")), "sk")
    at = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block)))
    cut = known.select("*", F.explode_outer(at).alias("block"))
    cut = cut.withColumns({"lo": F.greatest("first", F.col("block") * block), "hi": F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block)})
    if any(p["slots"] for p in plan):
        chosen = slots(spark, plan, shard_slots, seed)
    else:
        chosen = spark.createDataFrame([], "shard bigint, slot bigint, src bigint, block bigint, trim bigint")
    # both sides grow with the corpus; the planner would take the exploded draws for small
    got = cut.join(chosen.hint("merge"), ["src", "block"], "left")
    end = F.least("hi", F.col("block") * block + F.least("trim", F.lit(block)))
    took = F.when(F.col("slot").isNotNull() & (end > F.col("lo")), end - F.col("lo"))
    pieces = got.select(
        "doc_id", "source", "size", "source_size", "target", "first",
        F.when(took.isNotNull(), F.col("lo") - F.col("first")).alias("word_from"),
        F.when(took.isNotNull(), end - F.col("first")).alias("word_to"),
        F.when(took.isNotNull(), F.col("shard")).alias("shard"),
        F.when(took.isNotNull(), F.col("slot")).alias("slot"),
    )
    return sources.select("source", "source_size", "target"), pieces


def block_texts(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(shard, slot, text): the mix itself, words joined by spaces. Document ids must be unique."""
    held = pieces.where("slot is not null").select("doc_id", "shard", "slot", "first", "word_from", "word_to")
    word = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    cut = held.join(docs.select("doc_id", word.alias("w")), "doc_id").withColumn("part", F.array_join(F.slice("w", F.col("word_from").cast("int") + 1, (F.col("word_to") - F.col("word_from")).cast("int")), " "))
    parts = F.array_sort(F.collect_list(F.struct(F.col("first") + F.col("word_from"), "part")))
    return cut.groupBy("shard", "slot").agg(F.array_join(F.transform(parts, lambda p: p["part"]), " ").alias("text"))


def op3_source_mixing(docs: DataFrame) -> DataFrame:
    _, pieces = mix(docs)
    # a document without words has no place of its own in the stream: it is kept apart by null
    by = ["doc_id", "source", "size", "source_size", "target", "first"]
    took = F.coalesce(F.sum(F.col("word_to") - F.col("word_from")), F.lit(0)).alias("taken")
    some = pieces.where("size > 0").groupBy(*by).agg(took)
    none = pieces.where("size = 0").select(*by, F.lit(0).cast("bigint").alias("taken"))
    return some.unionByName(none).select("doc_id", "size", "source_size", "target", "taken", "source")
