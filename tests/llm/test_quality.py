"""The PU risk and its gradients against a version written out by itself, and trainers that share tasks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fastbreak.llm import quality


def plain_risk(p, mean, scale, positive, unlabelled, prior):
    """(whole risk, risk of the negatives) by loops over rows."""

    def logit(x):
        z = [min(6.0, max(-6.0, (a - m) / s)) for a, m, s in zip(x, mean, scale, strict=True)]
        h = [math.tanh(sum(z[i] * p[0][i, j] for i in range(len(z))) + p[1][j]) for j in range(len(p[1]))]
        return sum(a * b for a, b in zip(h, p[2], strict=True)) + p[3][0]

    loss = lambda g: math.log1p(math.exp(-g)) if g > 0 else -g + math.log1p(math.exp(g))
    average = lambda rows, sign: sum(loss(sign * logit(x)) for x in rows) / len(rows)
    negative = average(unlabelled, -1) - prior * average(positive, -1)
    return prior * average(positive, 1) + negative, negative


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_gradients_against_differences_of_the_plain_risk(shift):
    rng = np.random.default_rng(3)
    n = quality.N_FEATURES
    mean, scale = rng.normal(size=n), rng.uniform(0.5, 2, n)
    net = quality.Net(mean, scale)
    net.p = [rng.normal(size=x.shape) * 0.3 for x in net.p]
    positive, unlabelled = rng.normal(size=(7, n)) + shift, rng.normal(size=(9, n))
    net.p[3] = net.p[3] + (0.0 if not shift else 2.0)
    for prior in (0.3, 0.95):
        _, negative = plain_risk(net.p, mean, scale, positive, unlabelled, prior)
        part = (lambda r: r[0]) if negative >= -quality.BETA else (lambda r: -r[1])
        grads = quality.risk_gradients(net, positive, unlabelled, prior)
        for k, (values, grad) in enumerate(zip(net.p, grads, strict=True)):
            for at in [tuple(rng.integers(s) for s in values.shape) for _ in range(6)]:
                found = []
                for e in (1e-5, -1e-5):
                    moved = [x.copy() for x in net.p]
                    moved[k][at] += e
                    found.append(part(plain_risk(moved, mean, scale, positive, unlabelled, prior)))
                assert np.isclose((found[0] - found[1]) / 2e-5, np.asarray(grad)[at], atol=1e-6)


def test_both_sides_of_the_bound_are_reached():
    rng = np.random.default_rng(4)
    net = quality.Net(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES))
    x = rng.normal(size=(20, quality.N_FEATURES))
    net.p[3] = np.array([3.0])
    assert plain_risk(net.p, net.mean, net.scale, x, x, 0.2)[1] > 0 > plain_risk(net.p, net.mean, net.scale, x, x, 1.2)[1]


def test_trainers_in_one_task_or_many_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, quality.N_FEATURES))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, x array<double>")
    monkeypatch.setattr(quality, "TRAINER_ROWS", 40)
    monkeypatch.setattr(quality, "PASSES", 2)
    found = []
    for tasks in (1, 3, 100):
        monkeypatch.setattr(quality, "MOST_TASKS", tasks)
        found.append(np.array(quality.fit_rounds(rows.orderBy(F.rand(tasks)), x[:30], 0.4).pack()))
    assert np.allclose(found[0], found[1]) and np.allclose(found[0], found[2])


def test_stages_take_rows_that_are_not_written(spark):
    import corpus_pipeline as cp

    words = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    shared = " ".join(f"shared{i}" for i in range(60))
    texts = [words(0), words(0), words(1) + " " + shared, words(2) + " " + shared, words(3)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    one = cp.suffix_array_dedup(spark, cp.ngram_jaccard(spark, d, "/nowhere"), "/nowhere")
    other = cp.ngram_jaccard(spark, d, "/elsewhere")
    again = cp.ngram_jaccard(spark, d, "/nowhere")
    assert {r["doc_id"] for r in other.collect()} == {r["doc_id"] for r in again.collect()} == {0, 2, 3, 4}
    assert len(cp._LEFT["/nowhere"]) and one is not None
    one = cp.suffix_array_dedup(spark, again, "/nowhere")
    assert {r["doc_id"]: "shared30" in r["text"] for r in one.collect()} == {0: False, 2: False, 3: False, 4: False}


def test_class_borders():
    from fastbreak.llm import gru_lm

    for v in (2, 3, 5, 30, 1024, 2002):
        first = gru_lm.class_borders(v)
        assert first[0] == 0 and first[-1] == v and (np.diff(first) > 0).all() and (v < 100 or (np.diff(np.diff(first)) >= -1).all())
        net = gru_lm.Gru(np.arange(v, 0, -1.0))
        assert [int(c) for c in net.cls] == [c for c in range(net.c) for _ in range(first[c], first[c + 1])]
    first = gru_lm.class_borders(2002)
    p = 1 / np.arange(1, 2003)
    assert len(first) + (np.repeat(np.diff(first), np.diff(first)) * p).sum() / p.sum() < 75  # two equal square roots cost 90


def test_language_model_trainers_take_turns(spark, monkeypatch):
    from fastbreak.llm import gru_lm

    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"], 40)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lex = gru_lm.lexicon(df, gru_lm.count_words(df).cache())
    monkeypatch.setattr(gru_lm, "TRAINER_TOKENS", 150)
    found = []
    for tasks in (1, 2, 4):
        monkeypatch.setattr(gru_lm, "MOST_TASKS", tasks)
        found.append(np.frombuffer(gru_lm.train(df, lex).pack(), dtype=np.float32))
    assert np.allclose(found[0], found[1], atol=1e-5) and np.allclose(found[0], found[2], atol=1e-5)
