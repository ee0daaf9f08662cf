"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled 1; the unlabelled set is web text of any quality. With class prior p
the risk is p R(positives, +) + max(0, R(unlabelled, -) - p R(positives, -)), which stays unbiased
while it is non-negative; when a batch drives the last term below zero the step goes against it. The
loss is logistic, so the model's logit estimates the posterior and the score is its sigmoid. The
prior is estimated as the share of 1 among the labelled training rows; labels 0 are used nowhere else.

A text is described by statistics of its whole text: sizes, character classes, repetition of words,
windows and lines, entropy. Labels, language, source and ids are no inputs. A network with one hidden
layer is fitted in numpy. Its unlabelled set is every training row: mean and scale are taken over all
of them, and in each of `ROUNDS` rounds every row is read `PASSES` times by one of the trainers, whose
weights are averaged by the rows they read. Only the labelled positives are bounded: at most
`MAX_POSITIVE`, those with the smallest hashes, are held by every trainer. Every row is scored.

Defined cases: null and empty texts have all statistics 0 and get that point's score; without any
positive training row all scores are 0.5; a null doc_id counts as the empty text in the split;
repeated rows are each scored; labels of unknown documents are ignored, of repeated labels the
largest counts; an empty table gives an empty result; extra columns are not read.

Scale: one pass over the texts writes 20 numbers per row; nothing else reads texts. A trainer reads
about `TRAINER_ROWS` rows, so trainers grow with the corpus and not with the cluster; tasks do not, as
each takes its trainers one after the other. Batches and passes are the same at every size. One copy of
the weights (a few hundred numbers) reaches the driver in a round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fastbreak.llm.common import crc_mod, materialize, scratch

MAX_POSITIVE, TRAINER_ROWS = 20_000, 50_000
FOLDS, THRESHOLD = 5, 0.3
HIDDEN, ROUNDS, PASSES, BATCH, RATE, DECAY, SEED = 16, 3, 20, 64, 0.005, 1e-4, 7
#: Most tasks that trainers are dealt to; more trainers take turns.
MOST_TASKS = 2000
BETA = 0.0

UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
MARK = np.zeros(256, bool)
MARK[list(b".,;:?'\"()-")] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>@^_~=+\\/[]{}")] = True
BYTE_CLASSES = (UPPER, DIGIT, SPACE, MARK, SYMBOL)
N_FEATURES = 20


def features(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * N_FEATURES
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    share = counts[counts > 0] / size
    kinds = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    grams = len(set(zip(words, words[1:], words[2:], strict=False)))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in data.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.float64, n)
    return [
        math.log1p(size), math.log1p(n), lengths.mean(), lengths.std(), lengths.max() ** 0.5,
        kinds / n, (pairs + 1) / n, (grams + 2) / n if n > 2 else 1.0, same / n,
        *(float(counts[c].sum()) / size for c in BYTE_CLASSES),
        counts[0x21] / size, counts[0x80:].sum() / size, float(-(share * np.log2(share)).sum()), float(share.max()),
        1 - len(set(lines)) / len(lines), len(lines) / n,
    ]


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, x array<double>")


class Net:
    """Standardised inputs, one tanh layer, one logit."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED):
        self.mean, self.scale = mean, scale
        rng, k = np.random.default_rng(seed), len(mean)
        self.p = [rng.normal(0, 1 / math.sqrt(k), (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def pack(self) -> list[float]:
        return np.concatenate([p.ravel() for p in self.p]).tolist()

    def unpack(self, values: list[float]) -> Net:
        ends = np.cumsum([p.size for p in self.p])
        self.p = [x.reshape(p.shape) for x, p in zip(np.split(np.array(values), ends[:-1]), self.p, strict=True)]
        return self

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ self.p[0] + self.p[1])
        return z, h, h @ self.p[2] + self.p[3][0]

    def gradient(self, z: np.ndarray, h: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        dh = d[:, None] * self.p[2] * (1 - h * h)
        return [z.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[2], -30, 30)))


def risk_gradients(net: Net, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> list[np.ndarray]:
    """Gradients of the PU risk prior * E+[l(g)] + (Eu[l(-g)] - prior * E+[l(-g)]) with l(z) = log(1 + exp(-z)).

    Where the estimate in brackets, of the negatives' risk, is below -BETA, of its negative alone: a step back.
    """
    zp, hp, gp = net.forward(positive)
    zu, hu, gu = net.forward(unlabelled)
    sp, su = 1 / (1 + np.exp(-np.clip(gp, -500, 500))), 1 / (1 + np.exp(-np.clip(gu, -500, 500)))
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    if negative >= -BETA:
        dp, du = prior * (sp - 1) - prior * sp, su
    else:
        dp, du = prior * sp, -su
    return [a + b for a, b in zip(net.gradient(zp, hp, dp / len(positive)), net.gradient(zu, hu, du / len(unlabelled)), strict=True)]


def fit(net: Net, positive: np.ndarray, unlabelled: np.ndarray, prior: float, passes: int, seed: int) -> Net:
    """Minimises the non-negative PU risk; a pass reads every unlabelled row once, in batches of equal size but the last."""
    rng = np.random.default_rng(seed)
    m, v, t = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p], 0
    for _ in range(passes):
        order = rng.permutation(len(unlabelled))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            grads = risk_gradients(net, positive[rng.integers(len(positive), size=BATCH)], unlabelled[own], prior)
            t += 1
            for i, g in enumerate(grads):
                g = g + DECAY * net.p[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                net.p[i] = net.p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return net


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and scale of every statistic, combined inside tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
        for batch in batches:
            x = matrix(batch.column(0))
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(N_FEATURES), pa.int32()), pa.array([n] * N_FEATURES, pa.int64()), pa.array(s), pa.array(q)], names=["k", "n", "s", "q"])

    got = rows.select("x").mapInArrow(work, "k int, n bigint, s double, q double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("k").collect()
    n = got[0]["n"]
    mean = np.array([r["s"] for r in got]) / max(n, 1)
    return n, mean, np.sqrt(np.maximum(np.array([r["q"] for r in got]) / max(n, 1) - mean**2, 0)) + 1e-9


def fit_rounds(rows: DataFrame, positive: np.ndarray, prior: float) -> Net:
    """Rounds of `fit` in parallel over all rows with averaged weights."""
    n, mean, scale = moments(rows)
    net, trainers = Net(mean, scale), -(-n // TRAINER_ROWS)
    held = rows.sparkSession.sparkContext.broadcast(positive)
    own = rows.select(F.xxhash64("doc_id", "x").alias("h"), "x").withColumn("trainer", F.pmod("h", F.lit(trainers)))
    dealt = own.repartition(min(trainers, MOST_TASKS), "trainer").sortWithinPartitions("trainer", "h").select("trainer", "x")
    for k in range(ROUNDS):
        now = net.pack()

        def work(batches: Iterator[pa.RecordBatch], now=now, k=k) -> Iterator[pa.RecordBatch]:
            def trained(parts: list[np.ndarray]) -> pa.RecordBatch:
                x = np.concatenate(parts)
                got = fit(Net(mean, scale).unpack(now), held.value, x, prior, PASSES, SEED + k).pack()
                return pa.RecordBatch.from_arrays([pa.array([len(x)] * len(got), pa.int64()), pa.array(range(len(got)), pa.int32()), pa.array(got)], names=["n", "i", "w"])

            # the trainers of a task one after the other, each with its rows only
            last, parts = None, []
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if parts and ids[a] != last:
                        yield trained(parts)
                        parts = []
                    last = ids[a]
                    parts.append(x[a:b])
            if parts:
                yield trained(parts)

        mine = dealt.mapInArrow(work, "n bigint, i int, w double")
        mean_w = mine.groupBy("i").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("w")).orderBy("i").collect()
        net.unpack([r["w"] for r in mean_w])
    return net


def sample(rows: DataFrame, most: int) -> np.ndarray:
    """Statistics of the `most` rows with the smallest hashes."""
    hashed = rows.select(F.xxhash64("doc_id", "x").alias("h"), "x")
    n = rows.count()
    if n > 2 * most:  # so that tasks send about what is kept, not `most` rows each
        hashed = hashed.where(F.col("h") < int(-(2**63) + 2**64 * (1.5 * most / n)))
    picked = hashed.orderBy("h").limit(most).toArrow()
    return np.array(picked.column("x").to_pylist(), dtype=np.float64)


def train(described: DataFrame, labels: DataFrame, folds: int = FOLDS) -> Net | None:
    """Learns from rows outside fold 0 only."""
    rows = described.where(crc_mod(F.col("doc_id"), folds) != 0)
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality is not null")
    with scratch(described.sparkSession):
        marked = materialize(rows.join(materialize(known, "labels").hint("merge"), "doc_id").select("doc_id", "x", "quality"), "marked")
        positive = sample(marked.where("quality = 1"), MAX_POSITIVE)
        if not len(positive):
            return None
        prior = marked.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return fit_rounds(rows, positive, min(max(prior, 0.01), 0.99))


def score(described: DataFrame, net: Net | None) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"))
            s = net.score(x) if net else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    kind = described.schema["doc_id"].dataType.simpleString()
    return described.mapInArrow(work, f"doc_id {kind}, score double")


def op4_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    described = materialize(describe(docs), "statistics")
    scored = score(described, train(described, labels))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
