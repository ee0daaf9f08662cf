"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts anywhere else.

Several lengths are answered by one search; candidates follow the shortest.

Finding candidates. Any `length` bytes hold `length - GRAM + 1` grams of GRAM bytes; the one with the
smallest hash (the last on ties) is the string's anchor. Equal strings have equal anchors at equal
distances, so only runs of starts whose anchor hash occurs twice or more can repeat. A run with the
bytes its longest strings need, as far as the text has them, is a segment; identical segments are one.

Verifying candidates. Segments meet by anchor. Blocks of them are laid out in one text, anchors at
positions divisible by the cover's modulus, and the suffixes that start a candidate are sorted by
difference cover, one bucket (by leading bytes) at a time:

1. cover sample: positions whose residue is in the difference cover; their ranks are made once per
   block by prefix doubling from COVER_MOD bytes to at least the longest length;
2. a bucket's suffixes are sorted by their first 16 bytes, ties by the rank of the next cover
   position, which is never further away. Suffixes of equal content have equal residues here, so that position is equally far
   away in both; between residues the residue decides, which no repeat depends on;
3. neighbours are compared over exactly each length: by their first 16 bytes, by ranks of the depths
   that add up to less than it, and by the bytes left.

A bucket holds a bounded number of suffixes and ties cost one rank each, however long they are.

Anchors with more than HOT_SEGMENTS occurrences would fill one task. Their starts are counted by a
128-bit fingerprint of all the bytes of each length in a plain aggregation instead.

Defined cases: a null text is empty; texts shorter than `length` lose nothing; rows with equal texts
of at least `length` bytes lose everything; matches never cross documents and are judged on the
input; an empty table gives an empty result; extra columns pass through `remove_repeats`; lengths up to
GRAM and from 2 ** RUN_BITS bytes on are an error.

Scale: documents are known by the MD5 of their text, so copies are worked on once. Runs are exchanged
as a few numbers. Texts stay where they are, but for those with candidates, which cross the network
once to meet their runs and once more to be cut; beyond FEW_KEYS such texts all are dealt by key.
Right sides of joins have one row per key so hot partitions can be split. Tables between the steps are
deleted as soon as the next one is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fastbreak.llm.common import few, lookup, materialize, other_columns_aside, scratch, with_keys

LENGTH = 400
#: Bytes of a passage of more than 50 words of five bytes with the space after them.
PASSAGE = 256
GRAM = 64
CHUNK = 1 << 18
BLOCK_BYTES = 4 << 20
BUCKET_SUFFIXES = 1 << 18
HOT_SEGMENTS = 8000
COMBINE_BYTES = 32 << 20
SEEN = 1 << 20

#: A perfect difference set (every residue is a difference of two of its members).
COVER_MOD, COVER = 31, (0, 1, 3, 8, 12, 18)


def gram_hashes(a: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every run of `gram` bytes (a power of two), by doubling."""
    x, p, n = a.astype(np.uint64) + np.uint64(1), np.uint64(0x100000001B3), 1
    with np.errstate(over="ignore"):
        while n < gram:
            x = x[:-n] * p + x[n:]
            p, n = p * p, 2 * n
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from running minima inside blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchor_runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor, anchor hash) of the runs of starts that share an anchor."""
    total, parts = len(data) - length + 1, []
    low = np.uint64((1 << 20) - 1)
    for c in range(0, max(total, 0), CHUNK):
        end = min(c + CHUNK, total)
        h = gram_hashes(np.frombuffer(data, dtype=np.uint8)[c : end + length - 1], gram)
        packed = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # ties: the last
        at = (low - (sliding_min(packed, length - gram + 1) & low)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:] - 1, [len(at) - 1]))
        parts.append((first + c, last + c, at[first] + c, h[at[first]].view(np.int64)))
    if not parts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


#: A run as one number: first start, starts after it, place of the anchor after it; both are below the length.
RUN_BITS = 14


def pack_runs(first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    return first << 2 * RUN_BITS | (last - first) << RUN_BITS | (at - first)


def unpack_run(run: int) -> tuple[int, int, int]:
    """First start, last start, anchor."""
    first = run >> 2 * RUN_BITS
    return first, first + (run >> RUN_BITS & (1 << RUN_BITS) - 1), first + (run & (1 << RUN_BITS) - 1)


def layout(segments: list[bytes], anchors: list[int]) -> tuple[bytes, np.ndarray]:
    """One text with every segment's anchor at a multiple of COVER_MOD; where segments begin."""
    parts, starts, at = [], [], 0
    for s, a in zip(segments, anchors, strict=True):
        gap = -(at + a) % COVER_MOD
        parts += (b"\0" * gap, s)
        starts.append(at + gap)
        at += gap + len(s)
    return b"".join(parts) + b"\0" * 64, np.array(starts, dtype=np.int64)


def cover_ranks(text: bytes, length: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Ranks of the cover sample at depths 31, 62, ... up to at least `length`; the sample number of
    each residue in the cover (-1: not in it); and how far each residue is from the next one in it."""
    k, words = len(COVER), windows(text)
    pos = (np.arange(0, len(text) - 32, COVER_MOD)[:, None] + np.array(COVER)).ravel()
    pos = pos[pos <= len(words) - 25]
    first, second, third, fourth = (dense(words[pos + 8 * i] & ~np.uint64(0xFF if i == 3 else 0)) for i in range(4))  # 31 bytes
    ranks = [pair(pair(first, second), pair(third, fourth))]
    depth = COVER_MOD
    while depth < length:
        shift = k * (depth // COVER_MOD)
        r = ranks[-1]
        ahead = np.zeros(len(r), dtype=np.uint64)
        ahead[: max(0, len(r) - shift)] = r[shift:] + np.uint64(1)
        ranks.append(pair(r, ahead))
        depth *= 2
    number = np.full(COVER_MOD, -1, dtype=np.int64)
    number[list(COVER)] = np.arange(k)
    delta = np.array([next(d for d in range(COVER_MOD) if (r + d) % COVER_MOD in COVER) for r in range(COVER_MOD)])
    return ranks, number, delta


def dense(col: np.ndarray) -> np.ndarray:
    """Ranks of numbers; equal numbers share a rank."""
    order = np.argsort(col)
    now = col[order]
    new = np.zeros(len(order), dtype=np.uint64)
    new[1:] = now[1:] != now[:-1]
    out = np.empty(len(order), dtype=np.uint64)
    out[order] = np.cumsum(new, dtype=np.uint64)
    return out


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks."""
    return dense(a << np.uint64(32) | b)


def windows(text: bytes) -> np.ndarray:
    """The eight bytes at every position as a big-endian number."""
    return np.ndarray(shape=(len(text) - 7,), dtype=">u8", buffer=text, strides=(1,))


def same_bytes(p: np.ndarray, sample: np.ndarray, ranks: list[np.ndarray], words: np.ndarray, far: int, length: int) -> np.ndarray:
    """Which neighbours that agree in `far` bytes agree in `length`; `far`: most bytes from a start to its sample."""
    same, done, k = np.ones(len(p) - 1, dtype=bool), 0, len(COVER)
    units = max(0, (length - far) // COVER_MOD)
    for depth in range(len(ranks) - 1, -1, -1):
        if units >> depth & 1:
            x = ranks[depth][np.minimum(sample + k * done, len(ranks[depth]) - 1)]
            same &= x[1:] == x[:-1]
            done += 1 << depth
    for i in range(done * COVER_MOD, length, 8):
        x = words[np.minimum(p + min(i, length - 8), len(words) - 1)]
        same &= x[1:] == x[:-1]
    return same


def repeated_starts(segments: list[bytes], anchors: list[int], starts_of: list[int], lengths: tuple[int, ...] = (LENGTH,)) -> list[list[np.ndarray]]:
    """For each length and each of the distinct segments, which of its first starts occur again elsewhere.

    A start with fewer bytes left in its segment than a length does not count for it.
    """
    longest = max(lengths)
    text, at = layout(segments, anchors)
    counts = np.array(starts_of, dtype=np.int64)
    ends = np.cumsum(counts)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
    starts = np.repeat(at, counts) + inside
    left = np.repeat(np.array([len(s) for s in segments], dtype=np.int64), counts) - inside
    ranks, number, delta = cover_ranks(text, longest)
    full, words, k, far = ranks[-1], windows(text), len(COVER), int(delta.max())
    lead = (words[starts] >> np.uint64(40)).astype(np.int64)  # three bytes choose the bucket
    by_lead = np.argsort(lead, kind="stable")
    edges = np.concatenate((np.flatnonzero(np.diff(lead[by_lead], prepend=-1)), [len(starts)]))
    again = [np.zeros(len(starts), dtype=bool) for _ in lengths]
    begin = 0
    for e in range(1, len(edges)):
        if e + 1 < len(edges) and edges[e + 1] - edges[begin] <= BUCKET_SUFFIXES:
            continue
        own = by_lead[edges[begin] : edges[e]]
        begin = e
        p = starts[own]
        residue = p % COVER_MOD
        q = p + delta[residue]
        sample = q // COVER_MOD * k + number[q % COVER_MOD]
        keys = [words[p], words[p + 8]]
        tie = residue.astype(np.uint64) << np.uint64(48) | full[sample]
        order = np.lexsort([tie, *keys[::-1]])
        p, sample, residue, own = p[order], sample[order], residue[order], own[order]
        near = residue[1:] == residue[:-1]
        for c in keys:
            c = c[order]
            near &= c[1:] == c[:-1]
        for flags, length in zip(again, lengths, strict=True):
            group = np.concatenate(([0], np.cumsum(~(near & same_bytes(p, sample, ranks, words, far, length)))))
            whole = left[own] >= length
            flags[own] = whole & (np.bincount(group, weights=whole)[group] > 1)
    return [np.split(flags, ends[:-1]) for flags in again]


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true as (first, last)."""
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


RUNS = "key binary, run array<bigint>, hash array<bigint>"
SPANS = "array<struct<k:int,lo:int,hi:int>>"
SPANS_ARROW = pa.list_(pa.struct([("k", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())]))


def with_key(docs: DataFrame) -> DataFrame:
    """Adds _s_data (UTF-8 bytes) and _s_key (their MD5)."""
    df = docs.withColumn("_s_data", F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return df.withColumn("_s_key", F.unhex(F.md5("_s_data")))


def find_runs(docs: DataFrame, length: int) -> DataFrame:
    """One row per text of at least `length` bytes with its runs; copies in a task are skipped."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                for key, data in zip(batch.column(0).slice(i, 256).to_pylist(), batch.column(1).slice(i, 256), strict=True):
                    if key in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    first, last, at, h = anchor_runs(data.as_py(), length)
                    rows.append((key, pack_runs(first, last, at), h))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (1, 2))], names=["key", "run", "hash"])

    return long_texts(docs, length).mapInArrow(scan, RUNS)


def long_texts(docs: DataFrame, length: int) -> DataFrame:
    """(key, data) of the texts of at least `length` bytes."""
    return with_key(docs.select("text")).where(F.octet_length("_s_data") >= length).select(F.col("_s_key").alias("key"), F.col("_s_data").alias("data"))


def candidates(docs: DataFrame, length: int) -> DataFrame:
    """key, data, runs: distinct texts with at least one run whose anchor occurs again. Written."""
    with scratch(docs.sparkSession) as keep:
        runs = materialize(find_runs(docs, length), "runs")
        each = runs.dropDuplicates(["key"]).select("key", F.explode(F.arrays_zip("run", "hash")).alias("r")).select("key", "r.run", "r.hash")
        often = each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
        repeated = lookup(each, often, "hash", "anchors").where("n is not null")
        per = materialize(repeated.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("run", "hash", "n"))).alias("runs")), "repeated-runs")
        text = long_texts(docs, length)
        if few(per.select("key")):
            text = text.join(F.broadcast(per.select("key")), "key", "left_semi")
        return keep(materialize(text.dropDuplicates(["key"]).join(per.hint("merge"), "key"), "candidates"))


SEGMENTS = "anchor bigint, seg binary, n bigint, starts int, anchor_at int, data binary, hot boolean"
OWNERS = "seg binary, key binary, first array<int>"


def cut(data: bytes, runs: list[dict], longest: int, hot: int = HOT_SEGMENTS) -> dict[bytes, tuple[int, bool, int, int, bytes, list[int]]]:
    """Segments of a text by id: anchor hash, hot, number of starts, anchor's place, bytes, and where it stands."""
    out: dict[bytes, tuple] = {}
    for r in runs:
        first, last, at = unpack_run(r["run"])
        piece, n = data[first : last + longest], last - first + 1
        seg = hashlib.md5(b"%d %d %d " % (r["hash"], at - first, n) + piece).digest()
        if seg in out:
            out[seg][5].append(first)
        else:
            out[seg] = (r["hash"], r["n"] > hot, n, at - first, piece, [first])
    return out


def segments(found: DataFrame, longest: int, hot_segments: int) -> DataFrame:
    """Segments with the number of places they stand at, combined inside each task."""

    def emit(held: dict) -> pa.RecordBatch:
        rows = list(held.items())
        cols = [
            pa.array([v[0] for _, v in rows], pa.int64()), pa.array([s for s, _ in rows], pa.binary()), pa.array([v[5] for _, v in rows], pa.int64()), pa.array([v[2] for _, v in rows], pa.int32()),
            pa.array([v[3] for _, v in rows], pa.int32()), pa.array([v[4] for _, v in rows], pa.binary()), pa.array([v[1] for _, v in rows], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SEGMENTS.split(", ")])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for data, runs in zip(batch.column(0), batch.column(1), strict=True):
                for seg, (anchor, is_hot, n, at, piece, firsts) in cut(data.as_py(), runs.as_py(), longest, hot_segments).items():
                    if seg in held:
                        held[seg][5] += len(firsts)
                    else:
                        held[seg] = [anchor, is_hot, n, at, piece, len(firsts)]
                        size += len(piece) + 200
                if size > COMBINE_BYTES:
                    yield emit(held)
                    held, size = {}, 0
        yield emit(held)

    return found.select("data", "runs").mapInArrow(combine, SEGMENTS)


def owners(found: DataFrame, longest: int) -> DataFrame:
    """Where segments stand."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segs, keys, firsts = [], [], []
            for key, data, runs in zip(*batch.columns, strict=True):
                for seg, v in cut(data.as_py(), runs.as_py(), longest).items():
                    segs.append(seg)
                    keys.append(key.as_py())
                    firsts.append(v[5])
            yield pa.RecordBatch.from_arrays([pa.array(segs, pa.binary()), pa.array(keys, pa.binary()), pa.array(firsts, pa.list_(pa.int32()))], names=["seg", "key", "first"])

    return found.select("key", "data", "runs").mapInArrow(place, OWNERS)


def verify(segs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(seg, spans): the starts of each segment that repeat, by suffix sorting blocks of anchors."""

    def solve(block: dict) -> pa.RecordBatch:
        ids, rows = list(block), list(block.values())
        flags = repeated_starts([r[4] for r in rows], [r[3] for r in rows], [r[2] for r in rows], lengths)
        out = []
        for i, (s, r) in enumerate(zip(ids, rows, strict=True)):
            own = []
            for k, length in enumerate(lengths):
                f = flags[k][i]
                if r[1] > 1:  # it stands at several places, so all it holds repeats
                    f = np.arange(len(f)) <= len(r[4]) - length
                own += [{"k": k, "lo": a, "hi": b} for a, b in spans(f)]
            if own:
                out.append((s, own))
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.binary()), pa.array([x for _, x in out], SPANS_ARROW)], names=["seg", "spans"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, last = {}, 0, None
        for batch in batches:
            for anchor, seg, n, starts, at, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if anchor != last and size > BLOCK_BYTES:
                    yield solve(block)
                    block, size = {}, 0
                last = anchor
                if seg in block:
                    block[seg][1] += n
                else:
                    block[seg] = [anchor, n, starts, at, data]
                    size += len(data)
        if block:
            yield solve(block)

    cold = segs.where("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor")
    return cold.mapInArrow(work, f"seg binary, spans {SPANS}")


def verify_hot(segs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """The same for anchors that are too frequent to meet in one task."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, n, starts, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for k, length in enumerate(lengths):
                    own = range(min(starts, len(data) - length + 1))
                    digests = [hashlib.md5(data[i : i + length]).digest() for i in own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([seg] * len(own), pa.binary()), pa.array([k] * len(own), pa.int32()), pa.array(list(own), pa.int32()), pa.array(digests, pa.binary()), pa.array([n] * len(own), pa.int64())],
                        names=["seg", "k", "start", "print", "n"],
                    )

    own = segs.where("hot").groupBy("seg").agg(F.first("data").alias("data"), F.first("starts").alias("starts"), F.sum("n").alias("n")).select("seg", "n", "starts", "data")
    each = materialize(own.mapInArrow(prints, "seg binary, k int, start int, print binary, n bigint"), "prints")
    often = materialize(each.groupBy("k", "print").agg(F.sum("n").alias("n")).where("n > 1"), "repeated-prints")
    hit = each.drop("n").join(often.hint("merge"), ["k", "print"])
    starts = hit.groupBy("seg", "k").agg(F.array_sort(F.collect_set("start")).alias("s"))
    begins = F.filter("s", lambda x, i: F.coalesce(F.get("s", i - 1) != x - 1, F.lit(True)))
    ends = F.filter("s", lambda x, i: F.coalesce(F.get("s", i + 1) != x + 1, F.lit(True)))
    per = starts.select("seg", F.zip_with(begins, ends, lambda a, b: F.struct(F.col("k").alias("k"), a.alias("lo"), b.alias("hi"))).alias("spans"))
    return per.groupBy("seg").agg(F.flatten(F.collect_list("spans")).cast(SPANS).alias("spans"))


def find_repeats(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,), hot_segments: int = HOT_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """(candidates, cuts): texts by key, and per key the spans (k, start, end exclusive) of each length. Both are written."""
    if not GRAM < min(lengths) <= max(lengths) < 1 << RUN_BITS:
        raise ValueError(f"lengths must be above {GRAM} and below {1 << RUN_BITS} bytes")
    with scratch(docs.sparkSession) as keep:
        found = keep(candidates(docs, min(lengths)))
        segs = materialize(segments(found, max(lengths), hot_segments), "segments")
        hits = verify(segs, lengths)
        if not segs.where("hot").limit(1).isEmpty():
            hits = hits.unionByName(verify_hot(segs, lengths))
        known = lookup(owners(found, max(lengths)), hits, "seg", "repeats").where("spans is not null")
        each = known.select("key", F.explode("first").alias("first"), "spans").select("key", "first", F.explode("spans").alias("s"))
        size = F.element_at(F.array(*map(F.lit, lengths)), F.col("s.k") + 1)
        cover = each.select("key", F.col("s.k").alias("k"), (F.col("first") + F.col("s.lo")).alias("start"), (F.col("first") + F.col("s.hi") + size).alias("end"))
        raw = cover.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "start", "end"))).alias("cuts"))
        return found, keep(materialize(raw, "cuts"))


def merge(cuts: list[dict], k: int = 0) -> list[tuple[int, int]]:
    """Sorted spans of one length joined where they touch."""
    out: list[list[int]] = []
    for c in cuts:
        if c["k"] != k:
            continue
        if out and c["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], c["end"])
        else:
            out.append([c["start"], c["end"]])
    return [(a, b) for a, b in out]


def kept_bytes(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in cuts:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


CLEANED = "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage bigint"


def clean(found: DataFrame, raw: DataFrame) -> DataFrame:
    """Per key with anything repeated: what goes and what stays, and the bytes in repeats of the second length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = lambda cuts: sum(b - a for a, b in cuts)
        for batch in batches:
            rows = [(d.as_py(), merge(c), merge(c, 1)) for d, c in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            cols = [
                batch.column(0),
                pa.array([size(c) for _, c, _ in rows], pa.int64()),
                pa.array([len(c) for _, c, _ in rows], pa.int64()),
                pa.array([hashlib.sha256(kept_bytes(d, c)).hexdigest() for d, c, _ in rows], pa.string()),
                pa.array([size(c) for _, _, c in rows], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in CLEANED.split(", ")])

    return found.select("key", "data").join(raw.hint("merge"), "key").mapInArrow(work, CLEANED)


@other_columns_aside("text")
def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` with repeated passages cut out of text; a character that a cut splits goes with it.

    Rows with equal texts of at least `length` bytes end up empty, as everything in them repeats.
    """
    with scratch(docs.sparkSession) as keep:
        _, raw = find_repeats(docs, (length,))
        copies = long_texts(docs, length).groupBy("key").count().where("count > 1").select("key", F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("start"), F.lit(2**31 - 1).alias("end"))).alias("cuts"))
        cuts = raw.unionByName(copies).groupBy(F.col("key").alias("_s_key")).agg(F.array_sort(F.flatten(F.collect_list("cuts"))).alias("_s_cuts"))
        cuts = keep(materialize(cuts, "text-cuts"))
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [kept_bytes(d.as_py().encode(), merge(c)).decode("utf-8", "ignore") for d, c in zip(batch.column("text"), batch.column("_s_cuts").to_pylist(), strict=True)]
            cols = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    ids, keys = with_key(docs).drop("_s_data"), cuts.select("_s_key")
    touched = with_keys(ids, keys, ["_s_key"]).join(cuts.hint("merge"), "_s_key").select(*docs.columns, "_s_cuts").mapInArrow(work, schema)
    return touched.unionByName(with_keys(ids, keys, ["_s_key"], anti=True).select(*docs.columns))


def op10_suffix_dedup(docs: DataFrame, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """The contract's columns for LENGTH, and n_passage_bytes: bytes in repeated strings of PASSAGE bytes."""
    with scratch(docs.sparkSession) as keep:
        ids = with_key(docs.select("doc_id", "text")).select("doc_id", F.col("_s_key").alias("key"), F.octet_length("_s_data").cast("bigint").alias("n_bytes"), F.unhex(F.sha2("_s_data", 256)).alias("sha"))
        ids = keep(materialize(ids, "ids"))
        found, raw = find_repeats(docs, (LENGTH, PASSAGE), hot_segments)
        cleaned = clean(found, raw).select("key", F.struct("n_removed", "n_spans", "kept_sha256").alias("c"), "n_passage")
        copies = ids.where(F.col("n_bytes") >= PASSAGE).groupBy("key").agg(F.count("*").alias("n"), F.max("n_bytes").alias("n_bytes")).where("n > 1")
        whole = F.struct(F.col("n_bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"))
        copies = copies.select("key", F.when(F.col("n_bytes") >= LENGTH, whole).alias("c"), F.col("n_bytes").alias("n_passage"))
        result = cleaned.unionByName(copies).groupBy("key").agg(F.max("c").alias("c"), F.max("n_passage").alias("n_passage"))  # copies remove the most
        result = keep(materialize(result, "removed"))
    return ids.join(result.hint("merge"), "key", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("c.n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("c.n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("c.kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
        F.coalesce("n_passage", F.lit(0)).cast("bigint").alias("n_passage_bytes"),
    )
