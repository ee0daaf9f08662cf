"""Language-model scoring with a gated recurrent network.

Tokens are lower-cased (A-Z) words and one end per text. Counts of all training tokens give the base:
an add-one unigram. The model's vocabulary is the end, an unknown mark and the `MODEL_WORDS` most
frequent words, cut in classes by frequency, the first ones small; P(token) = P(class | state) P(token |
class, state). An unknown word costs P(unknown | state) times its add-one share among all words
outside the vocabulary, so probabilities sum to one over known words and one place for new ones.

Training is truncated backpropagation in numpy over every token of every training text, each read
once: `BATCH` lanes read texts to their ends, one after another, in windows of `WINDOW` tokens; the
state is carried over inside a text and starts anew with the next. Trainers work on their own
partitions for a round, then their weights are averaged by the tokens they read; the biases start at
the unigram, so the model starts as good as the base.
Scoring runs over whole texts in windows, many texts side by side, with the state carried to the end.
Words are cut, counted and looked up by Arrow's kernels, for many texts at once.

Defined cases: a null or empty text is its end alone; a null doc_id counts as the empty text in the
split; without training texts every count is 0 and the model is uniform; repeated rows are each
scored; an empty table gives an empty result; extra columns are not read.

Scale: counts are combined inside tasks before they are shuffled. The `HEAD_WORDS` most frequent words
are held by every task; for all others (document, word) pairs join the count table. Weights are about
half a megabyte. A trainer reads about `TRAINER_TOKENS` tokens in a round, so trainers grow with
the corpus and not with the cluster; above `MOST_TASKS` they take turns in that many tasks. Their copies are
averaged in each task, those of the tasks (1 GB at most) as a stream by one, and one copy reaches the driver in a round. A text is read in the round its
key names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fastbreak.llm.common import LOWER, UPPER, crc_mod, materialize, scratch

FOLDS, HELD_OUT = 7, 2
HEAD_WORDS, MODEL_WORDS = 1 << 16, 2000
HIDDEN, WINDOW, BATCH, RATE = 16, 32, 256, 0.005
ROUNDS, TRAINER_TOKENS, MOST_TASKS = 3, 1_500_000, 2000
COMBINE_BYTES = 32 << 20
SIDE_BY_SIDE = 512
CHUNK, ADAM_PIECE = 2048, 1 << 13
LONG_TEXT = 2048
PIECE_CHARS = 4 << 20
SEED = 11
END, UNKNOWN = 0, 1
ID = np.dtype("<u2")  # of the model's tokens in the training table, whose rows are the bytes of a text's ids
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
LN10 = math.log(10)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of some texts, one after another, and how many each text has: the same cut, by Arrow's kernels for all texts at once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, edges = lists.values, lists.offsets.to_numpy()
    flat, edges = flat.slice(edges[0], edges[-1] - edges[0]), edges - edges[0]
    # white space at either end of a text leaves an empty word there
    full = pc.not_equal(pc.binary_length(flat), 0)
    if pc.all(full).as_py():
        return flat, np.diff(edges).astype(np.int64)
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return flat.filter(full), np.diff(kept[edges])


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, at a time as many as hold `PIECE_CHARS` bytes; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(texts):
        before = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, before + PIECE_CHARS, side="right")))
        yield texts.slice(at, to - at)
        at = to


def string_array(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def places_in(flat: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each word stands in the list, or -1."""
    return pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy()


def with_ends(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids with END after each text."""
    return np.insert(ids, np.cumsum(sizes), END)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) of a table with a column text."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            got = pc.value_counts(pa.chunked_array(held, pa.string()))
            return pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], names=["word", "c"])

        for batch in batches:
            for texts in pieces(batch.column(0)):
                held.append(word_lists(texts)[0])
                size += held[-1].nbytes
                if size > COMBINE_BYTES:
                    yield emit()
                    held, size = [], 0
        yield emit()

    return texts.select("text").mapInArrow(combine, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """The frequent words with their counts, and the corpus totals."""

    def __init__(self, words: list[bytes], counts: list[int], texts: int, total: int, kinds: int):
        self.counts = dict(zip(words, counts, strict=True))
        model = words[:MODEL_WORDS]
        self.ids = {w: i + 2 for i, w in enumerate(model)}
        self.texts, self.total, self.kinds = texts, total + texts, kinds + (texts > 0)
        known = sum(counts[: len(model)])
        self.rest = total - known + kinds - len(model) + 1  # add-one total of the words outside the model
        self.unigram = np.array([texts + 1, max(total - known, 1), *(c + 1 for c in counts[: len(model)])], dtype=np.float64)

    @property
    def base_total(self) -> int:
        return self.total + self.kinds + 1


def lexicon(train: DataFrame, counts: DataFrame) -> Lexicon:
    texts = train.count()
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(HEAD_WORDS).toArrow()
    return Lexicon([w.encode() for w in top.column("word").to_pylist()], top.column("c").to_pylist(), texts, total, kinds)


def class_borders(v: int) -> np.ndarray:
    """First ids of the classes of v tokens by frequency, and v: sizes rise with the rank, so that frequent tokens have few neighbours.

    With c classes of sizes in steps of 2 v / c^2, and frequencies falling as 1 / rank, a token costs
    about c + 4 v / (c ln v) scores, which is least at c = sqrt(4 v / ln v).
    """
    c = max(1, round(math.sqrt(4 * v / math.log(max(v, 3)))))
    return np.unique(np.concatenate((np.ceil(v * (np.arange(c) / c) ** 2), [v])).astype(np.int64))


class Gru:
    """Weights and both directions of the network. The tokens of a class are neighbours: class c holds ids first[c] to first[c + 1]."""

    def __init__(self, unigram: np.ndarray, seed: int = SEED):
        rng, v, h = np.random.default_rng(seed), len(unigram), HIDDEN
        self.first = class_borders(v)
        self.c = c = len(self.first) - 1
        self.cls = np.repeat(np.arange(c, dtype=np.int16), np.diff(self.first))
        p = unigram / unigram.sum()
        mass = np.add.reduceat(p, self.first[:-1])
        f = np.float32
        with np.errstate(divide="ignore"):
            word_bias = np.where(p > 0, np.log(np.maximum(p, 1e-30)), -1e4)
        self.p = {
            "x": rng.normal(0, 0.3, (v, 3 * h)).astype(f),
            "u": rng.normal(0, 1 / math.sqrt(h), (h, 3 * h)).astype(f),
            "wc": rng.normal(0, 0.05, (h, c)).astype(f),
            "bc": np.log(np.maximum(mass, 1e-30)).astype(f),
            "ww": rng.normal(0, 0.05, (v, h)).astype(f),
            "bw": word_bias.astype(f),
        }

    def pack(self) -> bytes:
        return b"".join(x.tobytes() for x in self.p.values())

    def unpack(self, data: bytes) -> Gru:
        at = 0
        for name, x in self.p.items():
            self.p[name] = np.frombuffer(data, dtype=np.float32, count=x.size, offset=at).reshape(x.shape).copy()
            at += 4 * x.size
        return self

    def step(self, tokens: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """State after reading tokens; what the way back needs."""
        h, gates, new, hu = self.move(np.ascontiguousarray(self.p["x"][tokens].T), np.ascontiguousarray(h.T))
        return h.T, gates[:HIDDEN].T, gates[HIDDEN:].T, new.T, hu[2 * HIDDEN :].T

    def move(self, x: np.ndarray, h: np.ndarray, gates: np.ndarray | None = None, new: np.ndarray | None = None, hu: np.ndarray | None = None, out: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """The same with units along the first axis, so that every gate is one stretch of memory; x holds the tokens' columns."""
        n = HIDDEN
        hu = np.matmul(self.p["u"].T, h, out=hu)
        gates = np.add(x[: 2 * n], hu[: 2 * n], out=gates)
        np.exp(np.negative(gates, out=gates), out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        new = np.multiply(gates[:n], hu[2 * n :], out=new)
        new += x[2 * n :]
        np.tanh(new, out=new)
        out = np.subtract(h, new, out=out)
        out *= gates[n:]
        out += new
        return out, gates, new, hu

    def log_probs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each target; with grads also the gradient of -sum by the states."""
        out, back = self.log_probs_by_unit(np.ascontiguousarray(states.T), targets, grads)
        return out, None if back is None else back.T

    def log_probs_by_unit(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The same for states and gradients with units along the first axis. Targets are taken class by class, each class a slice."""
        p, cls, n = self.p, self.cls[targets], len(states)
        order = np.argsort(cls, kind="stable")
        targets, cls = targets[order], cls[order]
        # biases are weights of a unit that is always 1
        ones = np.empty((n + 1, len(order)), dtype=states.dtype)
        np.take(states, order, axis=1, out=ones[:n], mode="clip")
        ones[n] = 1
        states, wc, ww = ones, np.concatenate((p["wc"], p["bc"][None])).T, np.concatenate((p["ww"], p["bw"][:, None]), axis=1)
        edges = np.searchsorted(cls, np.arange(self.c + 1)).tolist()
        out, back = np.empty(len(targets), dtype=states.dtype), None if grads is None else np.empty((n, len(order)), dtype=states.dtype)
        places = np.arange(max(CHUNK, len(targets)))

        def softmax(w: np.ndarray, s: np.ndarray, at: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
            # choices lie along the first axis: reductions over it are fast
            e = w @ s
            if not plain:
                e -= e.max(0)
            own = places[: len(at)]
            score = e[at, own]
            np.exp(e, out=e)
            total = e.sum(0)
            score -= np.log(total)
            if grads is not None:
                e /= total
                e[at, own] -= 1
            return score, e

        plain = self.is_small(wc, np.zeros(1, dtype=np.int64))
        for lo in range(0, len(targets), CHUNK):  # what is worked on stays in the processor's cache
            k = slice(lo, lo + CHUNK)
            out[k], e = softmax(wc, states[:, k], cls[k], plain)
            if grads is not None:
                g = states[:, k] @ e.T
                grads["wc"] += g[:n]
                grads["bc"] += g[n]
                np.matmul(p["wc"], e, out=back[:, k])
        plain = self.is_small(ww, self.first[:-1])
        for c in range(self.c):
            w = slice(self.first[c], self.first[c + 1])
            for lo in range(edges[c], edges[c + 1], CHUNK):
                k = slice(lo, min(lo + CHUNK, edges[c + 1]))
                score, e = softmax(ww[w], states[:, k], targets[k] - self.first[c], plain)
                out[k] += score
                if grads is not None:
                    g = e @ states[:, k].T
                    grads["ww"][w] += g[:, :n]
                    grads["bw"][w] += g[:, n]
                    back[:, k] += p["ww"][w].T @ e
        place = np.empty_like(order)
        place[order] = places[: len(order)]
        return out[place], None if back is None else np.take(back, place, axis=1)

    @staticmethod
    def is_small(w: np.ndarray, first: np.ndarray) -> bool:
        """Whether no exponential of a state's scores, whose units are within -1 and 1, and no group's sum of them can leave float32: then no largest score need be taken off first."""
        bias, reach = w[:, -1], np.abs(w[:, :-1]).sum(1)
        return bool((bias + reach).max() < 40 and np.maximum.reduceat(bias - reach, first).min() > -40)

    def window(self, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, h: np.ndarray, restart: bool = False) -> tuple[dict, float, np.ndarray]:
        """Gradients over one window (time by text), its loss, and the state after it.

        With restart the state is empty wherever the token read is END, the start of another text.
        """
        t, b, n = *inputs.shape, HIDDEN
        kind, u = self.p["u"].dtype, self.p["u"]
        before, new = np.empty((2, t, n, b), dtype=kind)
        gates, hu, states = np.empty((t, 2 * n, b), dtype=kind), np.empty((t, 3 * n, b), dtype=kind), np.empty((n, t, b), dtype=kind)
        goes_on = (inputs != END)[:, None, :].astype(kind) if restart else None
        h = h.T
        for i in range(t):
            np.multiply(h, goes_on[i] if restart else 1, out=before[i])
            x = np.ascontiguousarray(np.take(self.p["x"], inputs[i], axis=0).T)
            h = self.move(x, before[i], gates[i], new[i], hu[i], states[:, i])[0]
        grads = {k: np.zeros_like(w) for k, w in self.p.items()}
        live, back = np.flatnonzero(mask), states.reshape(n, t * b)
        whole = len(live) == t * b
        scores, back = self.log_probs_by_unit(back if whole else np.take(back, live, axis=1), targets.ravel()[live], grads)
        dh_out = back if whole else np.zeros((n, t * b), dtype=kind)
        if not whole:
            dh_out[:, live] = back
        dh_out, dh = dh_out.reshape(n, t, b), np.zeros((n, b), dtype=kind)
        d, du = np.empty((3 * n, t, b), dtype=kind), np.empty((3 * n, b), dtype=kind)
        for i in range(t - 1, -1, -1):
            dh += dh_out[:, i]
            r, z, w = gates[i, :n], gates[i, n:], new[i]
            keep = 1 - z
            to_z = np.subtract(before[i], w, out=du[n : 2 * n])
            to_z *= z
            to_z *= keep
            to_z *= dh
            dnew = w * w
            np.subtract(1, dnew, out=dnew)
            dnew *= keep
            dnew *= dh
            to_r = np.subtract(1, r, out=du[:n])
            to_r *= r
            to_r *= hu[i, 2 * n :]
            to_r *= dnew
            np.multiply(dnew, r, out=du[2 * n :])
            d[: 2 * n, i], d[2 * n :, i] = du[: 2 * n], dnew
            grads["u"] += before[i] @ du.T
            dh *= z
            dh += u @ du
            if restart:
                dh *= goes_on[i]
        read = inputs.ravel()
        for k, row in enumerate(d.reshape(3 * n, t * b)):
            grads["x"][:, k] = np.bincount(read, row, len(self.p["x"]))
        scale = max(len(live), 1)
        for g in grads.values():
            g /= scale
        return grads, -float(scores.sum()) / scale, h.T


def lanes(texts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, mask, lanes kept from the window before) of windows, time by lane, that hold every token once.

    Row 0 of ids is what a lane read last. A lane takes the next text where its own ends; without
    another text it is given up after the window.
    """
    texts = iter(texts)
    open_ = [[x, 0] for x in itertools.islice(texts, BATCH)]
    last, kept = np.full(len(open_), END, dtype=np.int64), np.arange(len(open_))
    while open_:
        ids, mask = np.full((len(open_), WINDOW + 1), END, dtype=np.int64), np.zeros((len(open_), WINDOW), dtype=bool)
        ids[:, 0] = last
        for j, lane in enumerate(open_):
            at = 0
            while at < WINDOW and lane[0] is not None:
                part = lane[0][lane[1] : lane[1] + WINDOW - at]
                ids[j, at + 1 : at + 1 + len(part)] = part
                at, lane[1] = at + len(part), lane[1] + len(part)
                if lane[1] == len(lane[0]):
                    lane[:] = next(texts, None), 0
            mask[j, :at] = True
        long = int(mask.sum(1).max())
        yield np.ascontiguousarray(ids.T[: long + 1]), np.ascontiguousarray(mask.T[:long]), kept
        kept = np.array([j for j, lane in enumerate(open_) if lane[0] is not None], dtype=np.int64)
        open_, last = [open_[j] for j in kept], ids[kept, WINDOW]


def train_texts(net: Gru, texts: Iterator[np.ndarray]) -> int:
    """One pass of Adam over whole texts; how many tokens they hold. Every token weighs the same."""
    flat = np.concatenate([x.ravel() for x in net.p.values()])
    cuts = np.cumsum([0, *(x.size for x in net.p.values())])
    net.p = {k: flat[i:j].reshape(x.shape) for (k, x), i, j in zip(net.p.items(), cuts[:-1], cuts[1:], strict=True)}
    m, v, free = np.zeros((3, len(flat)), dtype=flat.dtype)
    t, n, most, h = 0, 0, 1, None
    for ids, mask, kept in lanes(texts):
        h = np.zeros((len(kept), HIDDEN), dtype=np.float32) if h is None else h[kept]
        grads, _, h = net.window(ids[:-1], ids[1:], mask, h, restart=True)
        live = int(mask.sum())
        t, n, most = t + 1, n + live, max(most, live)
        whole = np.concatenate([g.ravel() for g in grads.values()])
        # Adam in place and by pieces that stay in the processor's cache: new arrays of this size cost more than the arithmetic
        for k in range(0, len(flat), ADAM_PIECE):
            g, mean, square, step, weights = (x[k : k + ADAM_PIECE] for x in (whole, m, v, free, flat))
            g *= live / most  # the few lanes of a tail count for the tokens they hold
            mean *= 0.9
            mean += np.multiply(g, 0.1, out=step)
            square *= 0.999
            g *= g
            g *= 0.001
            square += g
            np.sqrt(np.multiply(square, 1 / (1 - 0.999**t), out=step), out=step)
            step += 1e-7
            np.divide(mean, step, out=step)
            step *= RATE / (1 - 0.9**t)
            weights -= step
    return n


def train(texts: DataFrame, lex: Lexicon) -> Gru:
    """Rounds of training in parallel with averaged weights; every text is read whole in one of them."""
    with scratch(texts.sparkSession):
        return train_rounds(texts, lex)


def dealt(whole: DataFrame, trainers: int, size: Column | None = None) -> DataFrame:
    """(trainer, ids) of a round, the texts of a trainer together: up to MOST_TASKS trainers have a task each, more of them take turns.

    Long texts come first, as one begun last keeps a trainer at windows of few lanes, which cost nearly as
    much as whole ones.
    """
    alone = trainers <= MOST_TASKS
    mine = whole.withColumn("trainer", F.lit(0) if alone else F.pmod(F.xxhash64("key"), F.lit(trainers)))
    mine = mine.repartition(trainers, "key") if alone else mine.repartition(MOST_TASKS, "trainer")
    return mine.sortWithinPartitions("trainer", (F.size("ids") if size is None else size) <= LONG_TEXT, "key").select("trainer", "ids")


def train_rounds(texts: DataFrame, lex: Lexicon) -> Gru:
    spark, net = texts.sparkSession, Gru(lex.unigram)
    words = spark.sparkContext.broadcast(list(lex.ids))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = string_array(words.value)
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(1)):
                flat, sizes = word_lists(texts)
                found = places_in(flat, known) + 2  # -1, a word outside, becomes UNKNOWN
                cuts = np.concatenate(([0], np.cumsum(sizes + 1)))
                data = with_ends(found.astype(ID), sizes)
                rows = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((cuts * ID.itemsize).astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), rows], names=["key", "ids"])
                at += len(sizes)

    # dealt by id and text: the same rows meet on any cluster, copies of one text go to different trainers
    keyed = texts.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    whole = materialize(keyed.mapInArrow(cut, "key bigint, ids binary"), "training-ids")
    size = F.octet_length("ids") / ID.itemsize
    n = int(whole.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])
    trainers = max(1, -(-n // (TRAINER_TOKENS * ROUNDS)))
    shape = spark.sparkContext.broadcast(lex.unigram)
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(net.pack())

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows = ((t, np.frombuffer(x.as_buffer(), dtype=ID)) for batch in batches for t, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
            total, mean = 0, 0.0
            for _, own in itertools.groupby(rows, key=lambda r: r[0]):  # the trainers of a task one after the other
                mine = Gru(shape.value).unpack(shared.value)
                n = train_texts(mine, (x for _, x in own))
                total, mean = total + n, mean + n * np.frombuffer(mine.pack(), dtype=np.float32).astype(np.float64)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([(mean / total).astype(np.float32).tobytes()], pa.binary())], names=["n", "weights"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, mean = 0, 0.0
            for batch in batches:
                for n, weights in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    total, mean = total + n, mean + n * np.frombuffer(weights.as_buffer(), dtype=np.float32).astype(np.float64)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([(mean / total).astype(np.float32).tobytes()], pa.binary())], names=["n", "weights"])

        mine = dealt(whole.where(F.pmod("key", F.lit(ROUNDS)) == k), trainers, size)
        # a copy of the weights from each task, at most MOST_TASKS; one task streams them in a fixed order and the driver gets their mean
        with scratch(spark):
            trained = materialize(mine.mapInArrow(work, "n bigint, weights binary"), "weights")
            got = trained.coalesce(1).sortWithinPartitions("n", "weights").mapInArrow(average, "n bigint, weights binary").collect()
        if got:
            net.unpack(bytes(got[0]["weights"]))
    return net


def score_ids(net: Gru, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of every whole sequence of token ids, each ending in END."""
    out = np.zeros(len(texts))
    order = np.argsort([-len(t) for t in texts], kind="stable")
    places = np.arange(SIDE_BY_SIDE)
    for k in range(0, len(order), SIDE_BY_SIDE):
        own = order[k : k + SIDE_BY_SIDE]
        lengths = np.array([len(texts[i]) for i in own])
        h, last = np.zeros((HIDDEN, len(own)), dtype=np.float32), np.full(len(own), END)
        for w in range(0, lengths[0], 2 * WINDOW):
            alive = int((lengths > w).sum())
            steps = min(2 * WINDOW, int(lengths[0]) - w)
            ids = np.full((steps, alive), END, dtype=np.int64)
            for j in range(alive):
                part = texts[own[j]][w : w + steps]
                ids[: len(part), j] = part
            states, targets, whose = [], [], []
            h, last = h[:, :alive], last[:alive]
            reading = np.searchsorted(-lengths[:alive], -w - np.arange(steps)).tolist()  # texts are in order of length
            for i, a in enumerate(reading):
                h = net.move(np.ascontiguousarray(np.take(net.p["x"], last[:a], axis=0).T), np.ascontiguousarray(h[:, :a]))[0]
                last = ids[i, :a]
                states.append(h)
                targets.append(last)
                whose.append(places[:a])
            scores, _ = net.log_probs_by_unit(np.concatenate(states, axis=1), np.concatenate(targets))
            out[own] += np.bincount(np.concatenate(whose), weights=scores.astype(np.float64), minlength=len(own))
    return out


def score(docs: DataFrame, counts: DataFrame, lex: Lexicon, net: Gru) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((lex, net))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lex, net = shared.value
        row = TaskContext.get().partitionId() << 40
        base_total, rest = math.log(lex.base_total), math.log(lex.rest)
        words = string_array(list(lex.counts))
        logs = np.log(np.fromiter(lex.counts.values(), np.float64, len(words)) + 1)
        end, known_words = math.log(lex.texts + 1), len(lex.ids)
        for whole in batches:
            for lo in range(0, whole.num_rows, 8 * SIDE_BY_SIDE):
                batch = whole.slice(lo, 8 * SIDE_BY_SIDE)
                seqs, tokens, known, base, extra, rare_words, rare_counts, rare_sizes = [], [], [], [], [], [], [], []
                for texts in pieces(batch.column(1)):
                    flat, sizes = word_lists(texts)
                    at = places_in(flat, words)
                    owner, head, inside = np.repeat(np.arange(len(sizes)), sizes), at >= 0, (at >= 0) & (at < known_words)
                    value = np.where(head, logs[at] if len(logs) else 0.0, 0.0)
                    per = lambda w: np.bincount(owner, weights=w, minlength=len(sizes))  # noqa: B023, E731
                    tokens.append(sizes + 1)
                    known.append(per(head).astype(np.int64) + (lex.texts > 0))
                    base.append(per(value) + end - (sizes + 1) * base_total)
                    extra.append(per(value * ~inside) - per(~inside) * rest)
                    seqs += np.split(with_ends(np.where(inside, at + 2, UNKNOWN).astype(np.int32), sizes), np.cumsum(sizes + 1)[:-1])
                    far = np.flatnonzero(~head)
                    coded = flat.take(pa.array(far)).dictionary_encode()
                    found, times = np.unique(owner[far] << 32 | coded.indices.to_numpy(), return_counts=True)
                    rare_words.append(coded.dictionary.take(pa.array(found & 0xFFFFFFFF)))
                    rare_counts.append(times.astype(np.int32))
                    rare_sizes.append(np.bincount(found >> 32, minlength=len(sizes)))
                lm = np.concatenate(extra) + score_ids(net, seqs)
                pairs = pa.StructArray.from_arrays([pa.concat_arrays(rare_words), pa.array(np.concatenate(rare_counts))], names=["word", "n"])
                ends = np.concatenate(([0], np.cumsum(np.concatenate(rare_sizes)))).astype(np.int32)
                cols = [
                    batch.column(0), pa.array(np.arange(row, row + batch.num_rows)), pa.array(np.concatenate(tokens)), pa.array(np.concatenate(known)),
                    pa.array(np.concatenate(base)), pa.array(lm), pa.ListArray.from_arrays(pa.array(ends), pairs),
                ]
                row += batch.num_rows
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n_tokens", "known", "base", "lm", "rare"])

    schema = f"doc_id {kind}, row bigint, n_tokens bigint, known bigint, base double, lm double, rare array<struct<word:string,n:int>>"
    # a rare word adds ln(c + 1) to both sums and counts as known; words without a count add nothing
    with scratch(spark) as keep:
        scored = materialize(docs.select("doc_id", "text").mapInArrow(work, schema), "scored")
        pairs = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
        found = pairs.join(counts.hint("merge"), "word").groupBy("row").agg(F.sum(F.col("n") * F.log(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("seen"))
        more = F.coalesce("more", F.lit(0.0))
        both = scored.drop("rare").join(found.hint("merge"), "row", "left").select(
            "doc_id",
            "n_tokens",
            (F.col("known") + F.coalesce("seen", F.lit(0))).cast("bigint").alias("n_known"),
            ((F.col("base") + more) / LN10).alias("base_score"),
            ((F.col("lm") + more) / LN10).alias("score"),
        )
        return keep(materialize(both, "scores"))


def op8_gru_scores(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", "text")
    with scratch(docs.sparkSession) as keep:
        training = own.where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
        counts = materialize(count_words(training), "word-counts")
        lex = lexicon(training, counts)
        scored = keep(score(own, counts, lex, train(training, lex)))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(lex.total).cast("bigint").alias("train_tokens"), "base_score", "score")
