"""Edit-aware token counts.

A document keeps its pre-tokens (the pieces a byte-pair tokenizer never merges across) in segments of
about `SEGMENT` pre-tokens, and trees of sums over the segments' token and character counts. An edit
replaces a range of characters. Only the segments it touches, with one on either side as context, are
cut again and encoded; the pieces are dealt over the same segments and the sums above them updated.
Cutting goes on segment by segment until a border of the old text is met, so the result always equals
a fresh count. Trees are rebuilt only when a region outgrows its segments `OVERFULL` times.

`index_documents` writes the state as a table: text, lengths of pre-tokens, pre-tokens of each segment
and both trees. `apply_edits` takes that table and a later batch of edits to the next state; rows
without edits are passed on as they are, without Python.

The encoder is a public byte-pair vocabulary in tiktoken form; its path is a parameter. A task keeps
the counts of pre-tokens it has met, up to `CACHE` of them.

Defined cases: a null text is empty; edits outside the text are clipped to it; a null place is 0, a
null insert inserts nothing; edits apply in order of seq, ties by start, end and insert; edits of
unknown or null documents are ignored; a document without edits keeps its counts; rows that repeat a
doc_id each get its edits; an empty table gives an empty result; extra columns are not read.

Scale: maps over documents. `attach_edits` joins edits by document id, grouped first, so a hot document
holds its edits and nothing else; the state is exchanged only for that join.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fastbreak.llm.common import materialize, scratch

SEGMENT, OVERFULL = 64, 4
CACHE = 1 << 19
ROWS = 256
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Counter:
    """Token counts of pre-tokens, remembered."""

    def __init__(self, vocabulary: str, pattern: str = PATTERN):
        import regex
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, int] = {}
        self.encoded = 0

    def count(self, pieces: list[str]) -> int:
        known, total = self.known, 0
        for p in pieces:
            n = known.get(p)
            if n is None:
                if len(known) >= CACHE:
                    known.clear()
                n = known[p] = len(self.encode(p))
            total += n
        self.encoded += len(pieces)
        return total


class Tree:
    """Sums over a list of numbers: binary tree in an array; a changed run updates the nodes above it."""

    def __init__(self, node: list[int]):
        self.node, self.n = node, len(node) // 2

    @classmethod
    def over(cls, leaves: list[int]) -> Tree:
        n = len(leaves)
        node = [0] * n + leaves
        for i in range(n - 1, 0, -1):
            node[i] = node[2 * i] + node[2 * i + 1]
        return cls(node)

    def set(self, i: int, value: int) -> None:
        i += self.n
        change = value - self.node[i]
        while i:
            self.node[i] += change
            i //= 2

    def total(self) -> int:
        return self.node[1] if self.n > 1 else sum(self.node[self.n :])

    def below(self, i: int) -> int:
        """Sum of the leaves before i."""
        lo, hi, out = self.n, self.n + i, 0
        while lo < hi:
            if lo & 1:
                out += self.node[lo]
                lo += 1
            if hi & 1:
                hi -= 1
                out += self.node[hi]
            lo, hi = lo // 2, hi // 2
        return out


class Document:
    """Text, lengths of its pre-tokens, pre-tokens of each segment, and trees of token and character counts."""

    def __init__(self, counter: Counter, text: str, pieces: np.ndarray, sizes: np.ndarray, tokens: Tree, chars: Tree):
        self.counter, self.text, self.pieces, self.sizes, self.tokens, self.chars = counter, text, pieces, sizes, tokens, chars

    @classmethod
    def fresh(cls, text: str, counter: Counter) -> Document:
        pieces = counter.cut(text)
        segments = [pieces[i : i + SEGMENT] for i in range(0, len(pieces), SEGMENT)] or [[]]
        lengths = np.fromiter(map(len, pieces), np.int32, len(pieces))
        tokens, chars = Tree.over([counter.count(s) for s in segments]), Tree.over([sum(map(len, s)) for s in segments])
        return cls(counter, text, lengths, np.array([len(s) for s in segments], dtype=np.int32), tokens, chars)

    def total(self) -> int:
        return self.tokens.total()

    def find(self, at: int) -> int:
        """The last segment that begins at or before character `at`."""
        lo, hi = 0, self.chars.n - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.chars.below(mid) <= at else (lo, mid - 1)
        return lo

    def edit(self, start: int, end: int, insert: str) -> None:
        size, last_segment = len(self.text), self.chars.n - 1
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        first = self.find(start)
        stop = max(first, self.find(max(start, end - 1)))
        first = max(first - 1, 0)
        while first and not self.sizes[first]:
            first -= 1
        base = self.chars.below(first)
        stop = min(stop + 1, last_segment)
        piece = int(self.sizes[: first].sum())
        while True:  # until what is cut again ends where a segment ended before
            while stop < last_segment and not self.sizes[stop + 1]:
                stop += 1
            upto = self.chars.below(stop + 1)
            new = self.text[base:start] + insert + self.text[end : max(upto, end)]
            if stop == last_segment:
                cut = self.counter.cut(new)
                break
            behind = int(self.sizes[: stop + 1].sum())
            following = self.pieces[behind : behind + self.sizes[stop + 1]].tolist()
            both = self.counter.cut(new + self.text[upto : upto + sum(following)])
            lengths = [len(p) for p in both]
            k = len(both) - len(following)
            if k >= 0 and lengths[k:] == following and sum(lengths[:k]) == len(new):
                cut = both[:k]
                break
            stop += 1
        behind, own = int(self.sizes[: stop + 1].sum()), stop + 1 - first
        lengths = np.fromiter(map(len, cut), np.int32, len(cut))
        self.text = self.text[:base] + new + self.text[max(upto, end) :]
        self.pieces = np.concatenate([self.pieces[:piece], lengths, self.pieces[behind:]])
        if len(cut) > OVERFULL * SEGMENT * own:
            parts = [cut[i : i + SEGMENT] for i in range(0, len(cut), SEGMENT)]
        else:  # the same segments, dealt evenly
            edges = [len(cut) * i // own for i in range(own + 1)]
            parts = [cut[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        counts, chars = [self.counter.count(x) for x in parts], [sum(map(len, x)) for x in parts]
        sizes = np.array([len(x) for x in parts], dtype=np.int32)
        if len(parts) == own:
            self.sizes[first : stop + 1] = sizes
            for i, (t, c) in enumerate(zip(counts, chars, strict=True), first):
                self.tokens.set(i, t)
                self.chars.set(i, c)
            return
        self.sizes = np.concatenate([self.sizes[:first], sizes, self.sizes[stop + 1 :]])
        for tree, values in ((self.tokens, counts), (self.chars, chars)):
            old = tree.node[tree.n :]
            tree.__init__(Tree.over(old[:first] + values + old[stop + 1 :]).node)


STATE = "text string, pieces array<int>, sizes array<int>, token_tree array<int>, char_tree array<int>"
EDIT = "struct<seq:int,start:int,end:int,insert:string>"


def state_batch(ids: pa.Array, docs: list[Document], more: dict[str, list[int]] | None = None) -> pa.RecordBatch:
    ints = lambda rows: pa.array(rows, pa.list_(pa.int32()))
    cols = {
        "doc_id": ids, "text": pa.array([d.text for d in docs], pa.string()), "pieces": ints([d.pieces for d in docs]), "sizes": ints([d.sizes for d in docs]),
        "token_tree": ints([d.tokens.node for d in docs]), "char_tree": ints([d.chars.node for d in docs]),
    }
    cols |= {k: pa.array(v, pa.int64()) for k, v in (more or {}).items()}
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def index_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, STATE): the state of every document of (doc_id, text)."""
    path, kind = vocabulary or default_vocabulary(), docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                yield state_batch(part.column(0), [Document.fresh(t.as_py() or "", counter) for t in part.column(1)])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {STATE}")


def attach_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """`state` with the edits (doc_id, seq, start, end, insert) of each document as a column."""
    with scratch(state.sparkSession) as keep:
        own = edits.where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end", "insert"))).cast(f"array<{EDIT}>").alias("edits"))
        own = keep(materialize(own, "edits"))
    return state.join(own.hint("merge"), "doc_id", "left")


def apply_edits(edited: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The next state of rows (doc_id, STATE, edits), with n_edits and n_recounted.

    n_recounted is the number of pre-tokens the edits had looked up again; a fresh count would look up
    all of them once per edit.
    """
    path, kind = vocabulary or default_vocabulary(), edited.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in STATE.split(", ")), "edits"]
    some = F.coalesce(F.size("edits"), F.lit(0)) > 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                docs, done, looked = [], [], []
                for text, pieces, sizes, tokens, chars, todo in zip(*(part.column(i) for i in range(1, 7)), strict=True):
                    ints = lambda x: x.values.to_numpy().astype(np.int32)
                    doc = Document(counter, text.as_py(), ints(pieces), ints(sizes), Tree(ints(tokens).tolist()), Tree(ints(chars).tolist()))
                    before = counter.encoded
                    for e in todo.as_py():
                        doc.edit(e["start"] or 0, e["end"] or 0, e["insert"] or "")
                    docs.append(doc)
                    done.append(len(todo))
                    looked.append(counter.encoded - before)
                yield state_batch(part.column(0), docs, {"n_edits": done, "n_recounted": looked})

    touched = edited.select(names).where(some).mapInArrow(work, f"doc_id {kind}, {STATE}, n_edits bigint, n_recounted bigint")
    zero = F.lit(0).cast("bigint")
    return touched.unionByName(edited.where(~some).select(*names[:-1], zero.alias("n_edits"), zero.alias("n_recounted")))


def counts(state: DataFrame) -> dict[str, Column]:
    """Totals of a state, read from the roots of its trees."""
    root = lambda c: F.when(F.size(c) > 2, F.get(c, F.lit(1))).otherwise(F.element_at(c, -1)).cast("bigint")
    return {"n_chars": root("char_tree"), "n_pretokens": F.size("pieces").cast("bigint"), "n_tokens": root("token_tree")}


def standing_edits(docs: DataFrame) -> DataFrame:
    """`docs` with a fixed edit script: a replacement in the middle, an insertion at a third, a deletion
    near the end."""
    size = F.length(F.coalesce("text", F.lit("")))

    def edit(seq, start, end, insert):
        return F.struct(F.lit(seq).alias("seq"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(insert).alias("insert"))

    zero = F.lit(0)
    script = F.array(
        edit(1, F.floor(size / 2), F.floor(size / 2) + 12, "edited words 42"),
        edit(2, F.floor(size / 3), F.floor(size / 3), " inserted\n\n"),
        edit(3, F.greatest(size - 9, zero), F.greatest(size - 4, zero), ""),
    )
    return docs.withColumn("edits", script)


def op5_edit_token_counts(docs: DataFrame) -> DataFrame:
    """Counts of every text, and after three edits applied to the state that was written."""
    with scratch(docs.sparkSession) as keep:
        state = keep(materialize(index_documents(docs), "token-index", "zstd"))
    before = {f"before_{k}": v for k, v in counts(state).items()}
    ids = state.schema["doc_id"].dataType.simpleString()
    names = ", ".join(f"{k}:bigint" for k in before)
    # the counts before travel beside the id
    kept = standing_edits(state).withColumn("doc_id", F.struct("doc_id", *(v.alias(k) for k, v in before.items())).cast(f"struct<doc_id:{ids},{names.replace(' ', '')}>"))
    after = apply_edits(kept)
    now = counts(after)
    return after.select(
        "doc_id.doc_id", *(F.col(f"doc_id.before_{k}").alias(k) for k in now),
        "n_edits", now["n_chars"].alias("n_chars_after"), now["n_tokens"].alias("n_tokens_after"), "n_recounted",
    )
