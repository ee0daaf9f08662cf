"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Words are runs of 0-9, a-z (after A-Z is lowered) and everything from U+0080 up. A benchmark item
gives one pattern per window of `window` consecutive words (shorter, non-empty items give one
pattern), each wrapped in single spaces so that it only matches on word borders. Every document is
normalised the same way, scanned once, and matches are mapped back to word numbers and to offsets in
the original text.

Defined cases: a null or word-less text has no words and no hits; a null or word-less item has no
window; items that share a window are all reported; rows with a null item_id are matched like others
(their hits carry a null id), but there is no id to list; repeated document rows are each reported; an empty benchmark hits
nothing; other columns of either table are not read.

Scale: the scan is a map over the documents without a shuffle. The patterns do not grow with the
documents. They are written as a table and dealt by hash in blocks of about `block_bytes`; the driver
and each task hold one block and its automaton at a time, however large the benchmark is. One block is
the rule; with more, the hits so far are written between the passes.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fastbreak.llm.common import materialize, other_columns_aside, scratch

WINDOW = 10
BLOCK_BYTES = 32 << 20
HITS = "array<struct<item_id:bigint,word_from:int,word_to:int,start:int,end:int>>"
HITS_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("word_from", pa.int32()), ("word_to", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

#: Bytes to normalised bytes: words stay, A-Z is lowered, the rest is a space.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def patterns(benchmark: DataFrame, window: int) -> DataFrame:
    """(pattern, item_id): the distinct windows of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = split_words(text)
                for i in range(max(1, len(w) - window + 1) if w else 0):
                    rows.add((b" " + b" ".join(w[i : i + window]) + b" ", item))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.binary()), pa.array([i for _, i in rows], pa.int64())], names=["pattern", "item_id"])

    picked = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    return picked.mapInArrow(cut, "pattern binary, item_id bigint")


def blocks(pats: DataFrame, block_bytes: int) -> Iterator[dict[bytes, list[int | None]]]:
    """The patterns in blocks, one at a time; a pattern is in one block, None stands for items without an id."""
    items = F.array_sort(F.collect_set("item_id"))
    all_ = F.when(F.max(F.col("item_id").isNull()), F.concat(items, F.array(F.lit(None).cast("bigint")))).otherwise(items)
    grouped = materialize(pats.groupBy("pattern").agg(all_.alias("items")), "patterns")
    used = grouped.agg(F.sum(F.length("pattern") + 8 * F.size("items"))).first()[0] or 0
    n = -(-used // block_bytes)
    for k in range(n):
        own = grouped if n == 1 else grouped.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == k)
        if block := {bytes(r["pattern"]): list(r["items"]) for r in own.collect()}:
            yield block


def automaton(block: dict[bytes, list[int]]):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for pattern, items in block.items():
        auto.add_word(pattern.decode("latin-1"), (pattern.count(b" ") - 1, items))
    auto.make_automaton()
    return auto


def scan(text: str | None, auto) -> tuple[int, list[dict]]:
    """Words of a text, and for each item the merged word ranges of its windows."""
    w = split_words(text)
    if not w:
        return 0, []
    flat = (b" " + b" ".join(w) + b" ").decode("latin-1")
    found = [(end, n, items) for end, (n, items) in auto.iter(flat)]
    if not found:
        return len(w), []
    starts, at = [], 1
    for x in w:
        starts.append(at)
        at += len(x) + 1
    ranges: dict[int, list[list[int]]] = {}
    for end, n, items in found:  # ends rise, so do the last words
        last = bisect.bisect_left(starts, end) - 1
        for item in items:
            own = ranges.setdefault(item, [])
            first = last - n + 1
            while own and own[-1][0] >= first:  # windows of other lengths may begin earlier
                own.pop()
            if own and own[-1][1] >= first - 1:
                own[-1][1] = last
            else:
                own.append([first, last])
    spans = [m.span() for m in WORD.finditer(text.translate(LOWERED))]
    return len(w), [{"item_id": item, "word_from": a, "word_to": b, "start": spans[a][0], "end": spans[b][1]} for item, own in ranges.items() for a, b in own]


LOWERED = {c: c + 32 for c in range(0x41, 0x5B)}


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` (with a column text) plus n_words and hits: item, word range and character range.

    Columns of these two names are replaced. Word ranges are inclusive; start and end are code-point offsets into the original text.
    """
    out = docs.withColumns({"n_words": F.lit(None).cast("bigint"), "hits": F.array().cast(HITS)})
    schema, spark = out.schema, docs.sparkSession
    with scratch(spark) as keep:
        todo = blocks(patterns(benchmark, window), block_bytes)
        block = next(todo, {})
        while block is not None:
            later = next(todo, None)
            out = scanned(out, spark.sparkContext.broadcast(block), schema)
            if later is not None:
                out = keep(materialize(out, "hits"))
            block = later
    return out


def scanned(docs: DataFrame, shared, schema) -> DataFrame:
    """n_words set, and the hits of one block added."""

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(shared.value) if shared.value else None
        for batch in batches:
            got = [scan(t, auto) if auto is not None else (len(split_words(t)), []) for t in batch.column("text").to_pylist()]
            n, hits = (batch.schema.get_field_index(c) for c in ("n_words", "hits"))
            both = [[*old, *new] for old, (_, new) in zip(batch.column(hits).to_pylist(), got, strict=True)]
            cols = list(batch.columns)
            cols[n] = pa.array([x for x, _ in got], pa.int64())
            cols[hits] = pa.array(both, HITS_ARROW)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(scan_batches, schema)


def n_hit(hits: Column) -> Column:
    """Distinct words that lie in any hit."""
    return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["word_from"], h["word_to"]))))).cast("bigint")


@other_columns_aside("text")
def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with their own columns."""
    return find_contamination(docs, benchmark).where(F.size("hits") == 0).select(*docs.columns)


def op1_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    items = F.array_compact(F.array_distinct(F.transform("hits", lambda h: h["item_id"].cast("string"))))
    found = find_contamination(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_words", n_hit(F.col("hits")).alias("n_hit"), F.array_sort(items).alias("items"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: DuckDB: the same windows by exploding words; lengths below the window come from short items.
SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
hit AS (
  SELECT d.doc_id, d.i, d.n, win.item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win))) d
  JOIN win ON win.n = d.n AND win.g = d.g),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(item_id) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, len(doc.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
