import math
import random

import numpy as np
import pytest

from treegrammar.llm import topk

SCHEMA = "vec_id long, embedding array<float>, v string, block string"


def plain(rows, k, asked):
    f32 = lambda e: [float(np.float32(x)) for x in e]
    good = [(i, [math.floor(256 * x) for x in f32(e)]) for i, e, *_ in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    queries = {}
    for i, v in good:
        if asked(i):
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 70)
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-2.0, -0.3, 0.0, 0.11, 0.25, 1.5]) for _ in range(6)], "x", "y") for i in range(300)]
    rows += [(1000 + i, [0.25] * 6, "x", "y") for i in range(30)]  # ties
    rows += [(9, None, "x", "y"), (10, [], "x", "y"), (11, [float("nan")] * 6, "x", "y"), (12, [1.0, None], "x", "y"), (13, [float("inf")] * 6, "x", "y"), (None, [1.0] * 6, "x", "y"), (14, [1e6] * 6, "x", "y"), (20, [0.5] * 3, "x", "y"), (15, [0.5] * 3, "x", "y"), (100, [0.25] * 6, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == plain(rows, 5, lambda i: i % 20 == 0)
    few = spark.createDataFrame(rows[:3], SCHEMA)
    assert len(topk.top_k(few, few, 5).collect()) == 6
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []


def test_what_64_bits_cannot_hold_is_an_error(spark):
    fits = [(1, [2.0**20, 1.0]), (2, [2.0**20, -1.0]), (50, [1.0, 1.0])]
    for bad in ([2.0**60, 0.0], [1e300, 0.0], [2.0**45, 2.0**45]):
        df = spark.createDataFrame([*fits, (100, bad), (101, bad)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="too large|64 bits"):
            topk.top_k(df, df.where("vec_id % 50 = 0")).collect()
    df = spark.createDataFrame(fits, "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 50")).collect()] == [(1, 2**36 + 2**16), (2, 2**36 - 2**16)]


def test_blocks_of_few_values(spark, monkeypatch):
    monkeypatch.setattr(topk, "VALUES", 40)
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=7).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = {i: np.floor(np.array(v) * 256).astype(int) for i, v in rows}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect()}
    for a in (0, 50, 100):
        best = sorted((-int(q[a] @ q[b]), b) for b in q if b != a)[:5]
        assert [got[a, k + 1] for k in range(5)] == [(b, -s) for s, b in best]
