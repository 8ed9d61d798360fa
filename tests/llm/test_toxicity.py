import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treegrammar.llm import toxicity as tx

DOCS, LABELS = "doc_id long, text string, toxic string, h long", "doc_id long, quality int, toxic int, text string"


def categories():
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def corpus(n=500):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(5, 60))]
        bad, junk = i % 6 == 0, i % 4 == 1
        if bad:
            words.insert(rnd.randrange(len(words)), rnd.choice(["Vile,", "rotten!", "vile"]))
        if junk:
            words += ["click"] * 3
        docs.append((i, " ".join(words), "x", 1))
        labels.append((i, int(not junk), int(bad), "z"))
    return docs, labels


def test_chain_learns_both_categories(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, DOCS)
    known = spark.createDataFrame(labels[:300] + [(None, 1, 1, "z"), (5, None, 1, "z"), (9999, 0, 1, "z"), labels[0]], LABELS)
    models = tx.train(df, known, categories())
    assert [len(m.earlier) for m in models] == [0, 1]
    extra = [(None, None, "x", 1), (600, "", "x", 1), (601, "vile " * 50_000, "x", 1), (0, docs[0][1], "x", 1)]
    got = tx.predict(df.union(spark.createDataFrame(extra, DOCS)), models, list(categories())).collect()
    assert len(got) == len(docs) + len(extra)
    by = {r.doc_id: r for r in got}
    for i, quality, toxic, _ in labels[300:]:
        assert (by[i].p_toxic > tx.THRESHOLD) == bool(toxic) and (by[i].p_low_quality > 0.5) == (not quality)
    assert by[601].p_toxic > 0.9 and by[600].p_toxic == by[None].p_toxic < tx.THRESHOLD


def test_no_labels_and_no_documents(spark):
    docs, labels = corpus(20)
    df, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    models = tx.train(df, known.limit(0), categories())
    assert {r.p_toxic for r in tx.predict(df, models, list(categories())).collect()} == {0.5}
    assert tx.predict(df.limit(0), models, list(categories())).collect() == []


def test_later_models_train_on_out_of_fold_inputs(monkeypatch):
    seen = []
    monkeypatch.setattr(tx, "fit", lambda rows, cols, n, earlier, y: seen.append((n, earlier.shape[1])) or tx.Linear(np.zeros(tx.DIMS), np.zeros(earlier.shape[1]), float(y.mean())))
    labels = np.array([[i % 2, i % 3 == 0] for i in range(20)], int)
    tx.chain(np.arange(20), np.arange(20), labels, np.arange(20) % tx.FOLDS)
    assert seen == [(20, 0)] + [(16, 0)] * tx.FOLDS + [(20, 1)]


def test_chain_equals_plain_code():
    """Out-of-fold probabilities of the first category feed the second's model; in prediction those of the model of all rows do."""
    rnd = np.random.default_rng(8)
    n = 60
    rows = np.repeat(np.arange(n), 6)
    cols = rnd.integers(0, 25, len(rows))
    first = (np.bincount(rows, cols < 8, n) > 2).astype(int)
    labels = np.stack([first, first & (rnd.random(n) < 0.7)], 1)
    fold = np.arange(n) % tx.FOLDS
    got = tx.chain(rows, cols, labels, fold)
    plain = lambda m, r, earlier: 1 / (1 + np.exp(-(sum(m.words[c] for c in cols[rows == r]) + sum(a * b for a, b in zip(earlier, m.earlier)) + m.bias)))
    out = np.zeros((n, 1))
    for k in range(tx.FOLDS):
        train = [r for r in range(n) if fold[r] != k]
        keep = np.isin(rows, train)
        m = tx.fit(np.searchsorted(train, rows[keep]), cols[keep], len(train), np.zeros((len(train), 0)), labels[train, 0].astype(float))
        for r in range(n):
            if fold[r] == k:
                out[r] = plain(m, r, [])
    assert ((out > 0) & (out < 1)).all()
    second = tx.fit(rows, cols, n, out, labels[:, 1].astype(float))
    assert np.allclose(got[1].words, second.words) and np.allclose(got[1].earlier, second.earlier) and np.isclose(got[1].bias, second.bias)
    assert np.allclose(got[0].words, tx.fit(rows, cols, n, np.zeros((n, 0)), labels[:, 0].astype(float)).words)


def test_predictions_feed_probabilities_forward(spark):
    words = np.zeros(tx.DIMS)
    bad = tx.Words().buckets("bad")[0]
    words[bad] = 2.0
    models = [tx.Linear(words, np.zeros(0), -1.0), tx.Linear(words / 2, np.array([3.0]), -2.0)]
    rows = tx.predict(spark.createDataFrame([(1, "bad bad"), (2, "fine"), (3, None)], "doc_id long, text string"), models, ["a", "b"]).collect()
    for r in rows:
        hit = r.doc_id == 1
        a = 1 / (1 + math.exp(-(2.0 * hit - 1)))
        assert r.p_a == pytest.approx(a) and r.p_b == pytest.approx(1 / (1 + math.exp(-(hit + 3 * a - 2))))


def test_a_label_repeated_many_times_is_learned_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tx, "chain", lambda rows, cols, labels, fold: seen.append(labels.tolist()) or [])
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 500 + [(1, 0), (2, 1), (None, 1), (3, 1)], "doc_id long, toxic int")
    tx.train(docs, labels, {"toxic": F.col("toxic") == 1})
    assert sorted(seen[0]) == [[0], [1], [1]]
