r"""License scans by a generalised suffix automaton of licence words.

All templates and phrases go into one automaton of words. A text is read once, word by word; the
state and the length of the longest match that ends at each word (the matching statistics) tell, up
the suffix links, which places of which templates end there too, and how far back each matches.
Matches of MIN_MATCH words or more are followed along their diagonals to their ends, and those of one
template that lie in order, at most MAX_GAP words apart, are chained; the share of the template's words
that a chain covers is its coverage. Phrases count where they stand whole.

Scale: a map over documents without a shuffle; the automaton follows from the templates and is built in
each task. A text costs its words plus its matches; chains look back over MAX_GAP words only.

Defined cases: a null text is empty; a text without words has no spans and a score of 0; words are
`[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z; other columns pass through, those named
n_words, spans and score are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from fastbreak.llm.license_texts import MORE_PHRASES, PHRASES, TEMPLATES

#: Words of a match worth chaining, words between matches of a chain, and the share of a template that makes a label.
MIN_MATCH, MAX_GAP, LEAST_COVERAGE = 5, 60, 0.5

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWERED = {c: c + 32 for c in range(0x41, 0x5B)}

SPANS = ArrayType(StructType([StructField("label", StringType()), StructField("base", BooleanType()), StructField("coverage", DoubleType()), *(StructField(c, LongType()) for c in ("word_from", "word_to", "start", "end"))]))
SPANS_ARROW = to_arrow_type(SPANS)


def split_words(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWERED))


class Vocabulary(dict):
    """Word -> number; words of no template are -1."""

    def __missing__(self, word: str) -> int:
        return -1


class Automaton:
    """States of the suffix automaton of several word sequences, with the places where each ends."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str, bool]]):
        self.length, self.link, self.go = [0], [-1], [{}]
        self.vocabulary = Vocabulary()
        self.labels, self.sizes = [], []
        ends: dict[int, list[tuple[int, int]]] = {}
        for label, text in templates:
            at, ids = 0, self.numbered(text)
            for i, x in enumerate(ids):
                at = self.extend(at, x)
                ends.setdefault(at, []).append((len(self.labels), i))
            self.labels.append(label)
            self.sizes.append(len(ids))
        self.phrases = phrases
        for text, _, _ in phrases:
            at = 0
            for x in self.numbered(text):
                at = self.extend(at, x)
        named: dict[int, list[tuple[int, int]]] = {}
        for k, (text, _, _) in enumerate(phrases):
            at, ids = 0, self.numbered(text)
            for x in ids:
                at = self.go[at][x]
            named.setdefault(at, []).append((len(ids), k))
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        below: list[set] = [set(ends.get(s, ())) for s in range(len(self.length))]
        for s in reversed(by_length):
            if self.link[s]:
                below[self.link[s]] |= below[s]
        # per state: (length, places) of itself and up its links, places already seen further down left out; phrases of all of them
        self.places: list[list] = [[] for _ in self.length]
        self.named: list[list] = [[] for _ in self.length]
        for s in by_length:
            up, seen = s, set()
            while up > 0 and self.length[up] >= MIN_MATCH:
                if own := sorted(below[up] - seen):
                    self.places[s].append((self.length[up], own))
                    seen |= below[up]
                up = self.link[up]
            self.named[s] = sorted(named.get(s, []) + (self.named[self.link[s]] if self.link[s] > 0 else []))

    def numbered(self, text: str) -> list[int]:
        return [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in split_words(text)]

    def state(self, length: int, link: int, go: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.go.append(go)
        return len(self.length) - 1

    def extend(self, last: int, x: int) -> int:
        """The state of the sequence of `last` with one word more."""
        if x in self.go[last]:
            to = self.go[last][x]
            return to if self.length[to] == self.length[last] + 1 else self.split(last, x, to)
        new, at = self.state(self.length[last] + 1, 0, {}), last
        while at >= 0 and x not in self.go[at]:
            self.go[at][x] = new
            at = self.link[at]
        if at >= 0:
            to = self.go[at][x]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self.split(at, x, to)
        return new

    def split(self, at: int, x: int, to: int) -> int:
        """A state for the shorter sequences of `to`, those that `at` reaches."""
        short = self.state(self.length[at] + 1, self.link[to], dict(self.go[to]))
        self.link[to] = short
        while at >= 0 and self.go[at].get(x) == to:
            self.go[at][x] = short
            at = self.link[at]
        return short

    def matches(self, words: list[str]) -> tuple[list[tuple[int, int, int]], dict[int, list[tuple[int, int, int]]]]:
        """Phrases as (first, last word, phrase), and per template its longest diagonal matches as (last word, last template word, words)."""
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))
        known = np.concatenate(([0], (ids >= 0).view(np.int8), [0]))
        edge = np.flatnonzero(np.diff(known))
        found, diagonals = [], {}
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a > 1:
                self.run(ids[a:b].tolist(), a, found, diagonals)
        return found, diagonals

    def run(self, ids: list[int], offset: int, found: list, diagonals: dict) -> None:
        """Matches in a run of known words; none reaches over an unknown one."""
        length, link, go = self.length, self.link, self.go
        at = n = 0
        open_: dict[tuple[int, int], int] = {}
        for i, x in enumerate(ids, offset):
            while at and x not in go[at]:
                at = link[at]
                n = length[at]
            if x in go[at]:
                at, n = go[at][x], n + 1
            for size, k in self.named[at]:
                if size <= n:
                    found.append((i - size + 1, i, k))
            if n >= MIN_MATCH:
                for size, places in self.places[at]:
                    for t, e in places:
                        own = diagonals.setdefault(t, [])
                        k = open_.get((t, i - e))
                        if k is not None and own[k][0] == i - 1:
                            own[k] = (i, e, min(size, n))
                        else:
                            open_[t, i - e] = len(own)
                            own.append((i, e, min(size, n)))

    def chains(self, template: int, matches: list[tuple[int, int, int]]) -> list[tuple[float, int, int]]:
        """(coverage, first word, last word) of matches of one template joined in order of both texts."""
        matches = sorted(matches)
        best, before = [], []
        low = 0
        for k, (x, e, n) in enumerate(matches):
            while matches[low][0] < x - n - MAX_GAP:
                low += 1
            score, prior = n, -1
            for j in range(low, k):
                px, pe, pn = matches[j]
                if px < x and pe < e and px - pn < x - n and pe - pn < e - n:
                    shared = max(0, px - (x - n), pe - (e - n))
                    if best[j] + n - shared > score:
                        score, prior = best[j] + n - shared, j
            best.append(score)
            before.append(prior)
        used, out = set(), []
        for k in sorted(range(len(matches)), key=lambda k: (-best[k], k)):
            if k in used:
                continue
            first, at = k, k
            while at >= 0 and at not in used:
                used.add(at)
                first, at = at, before[at]
            # a chain that leads into one already taken keeps its own words only
            covered = best[k] - (best[at] if at >= 0 else 0)
            out.append((covered / self.sizes[template], matches[first][0] - matches[first][2] + 1, matches[k][0]))
        return out

    def scan(self, text: str) -> tuple[int, list[dict], float]:
        """Number of words, spans of phrases and of templates covered enough, and the largest coverage."""
        words = split_words(text)
        found, diagonals = self.matches(words)
        spans = [(self.phrases[k][1], self.phrases[k][2], 1.0, a, b) for a, b, k in found]
        most = 1.0 if spans else 0.0
        for t, matches in diagonals.items():
            for coverage, a, b in self.chains(t, matches):
                most = max(most, coverage)
                if coverage >= LEAST_COVERAGE:
                    spans.append((self.labels[t], False, coverage, a, b))
        if not spans:
            return len(words), [], most
        at = [m.span() for m in WORD.finditer(text.translate(LOWERED))]
        spans.sort(key=lambda s: (s[3], s[4], s[0]))
        return len(words), [dict(zip(NAMES, (*s, at[s[3]][0], at[s[4]][1]), strict=True)) for s in spans], most


NAMES = ("label", "base", "coverage", "word_from", "word_to", "start", "end")


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """`docs` (with a column text) plus n_words, spans (label, base, coverage, word range, code-point range) and score, the largest coverage.

    `phrases` (words: label) give the spans marked base; `more` and `templates` (label: text) give others.
    """
    texts = list((TEMPLATES if templates is None else templates).items())
    named = [*((p, label, True) for p, label in (PHRASES if phrases is None else phrases).items()), *((p, label, False) for p, label in (MORE_PHRASES if more is None else more).items())]
    out = docs.withColumns({"n_words": F.lit(0).cast("bigint"), "spans": F.array().cast(SPANS), "score": F.lit(0.0)})

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(texts, named)
        for batch in batches:
            got = [auto.scan(t or "") for t in batch.column("text").to_pylist()]
            cols = list(batch.columns)
            for i, (c, kind) in enumerate((("n_words", pa.int64()), ("spans", SPANS_ARROW), ("score", pa.float64()))):
                cols[batch.schema.get_field_index(c)] = pa.array([x[i] for x in got], kind)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return out.mapInArrow(scan_batches, out.schema)


def joined_labels(spans: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def op11_license_scan(docs: DataFrame) -> DataFrame:
    """The query: all phrases and templates over whole texts."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["word_from"])
    return find_licenses(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined_labels(base).alias("base_labels"), joined_labels(F.col("spans")).alias("labels"), "score",
    )
