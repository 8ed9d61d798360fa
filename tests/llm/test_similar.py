import os
import random

import pytest

import corpus_pipeline as cp
from treegrammar.llm import similar

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def survivors(rows, least=0.8):
    """Ids that stay when each component of pairs with this similarity keeps its least id."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= least:
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(d, best.get(find(i), d))
    return sorted(best.values())


def kept(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    return sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, SF).collect())


def test_stage_drops_every_pair_of_so_similar_texts(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    line = " ".join(word() for _ in range(12))
    rows = []
    for n in [6, 9, 20, 60, 150, 600] * 4:
        base = [word() for _ in range(n)] + line.split()
        rows.append((len(rows), " ".join(base)))
        for edits in (1, n // 60 + 1, n // 30 + 1, n // 20 + 1):
            t = list(base)
            for _ in range(edits):
                t[rnd.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t)))
    hot = [word() for _ in range(80)]  # one large group
    for i in range(60):
        t = list(hot)
        t[i] = word()
        rows.append((len(rows), " ".join(t)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "two words")]
    want = survivors(rows)
    assert kept(spark, rows) == want and 30 < len(want) < len(rows) - 60


def test_prefixes_of_similar_sets_meet():
    import numpy as np

    rnd = np.random.default_rng(1)
    common = rnd.integers(0, 3, similar.SLOTS)
    for n in (1, 2, 5, 9, 10, 44, 300):
        for swap in range(n // 9 + 1):
            a = np.unique(rnd.integers(0, 2**62, n).astype(np.uint64))
            b = np.unique(np.append(a[swap:], rnd.integers(0, 2**62, swap).astype(np.uint64)))
            if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                assert len(np.intersect1d(similar.prefix(a, common, 0.8), similar.prefix(b, common, 0.8)))


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_stage_on_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = survivors([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, SF).collect()) == want


def test_long_parities_never_exceed_the_difference():
    import numpy as np

    rnd = np.random.default_rng(5)
    for n in (0, 1, 3, 200, 511, 512, 513, 3000):
        for m in (n, n * 5 // 4, n // 2):
            a = np.unique(rnd.integers(0, 2**62, n).astype(np.uint64))
            b = np.unique(np.append(a[: m // 2], rnd.integers(0, 2**62, m - m // 2).astype(np.uint64)))
            apart = len(np.setxor1d(a, b))
            got = similar.least_apart(similar.long_parities(a), similar.long_parities(b))
            assert got <= apart and (apart < 100 or got > 0.25 * apart)
