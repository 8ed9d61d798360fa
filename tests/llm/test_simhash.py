import random

import numpy as np
import xxhash

from treegrammar.llm import simhash

SCHEMA = "doc_id long, text string, node string, fp string"


def plain_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=3):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least.get(find(i)) for i in range(len(ids))]


def test_against_brute_force(spark):
    rnd = random.Random(5)
    words = ["alpha", "BETA", "gamma,", "δέλτα", "eps\tx", "zeta\x0bq"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60))) for _ in range(60)]
    texts = base + base[:10] + [None, "", "  ", "one", "two words", "x " * 70_000] + [t + " tail" for t in base[:30]]
    rows = [(i * 3 % 1000, t, "n", "f") for i, t in enumerate(texts)] + [(None, base[0], "n", "f"), (0, base[0], "n", "f")]
    got = {}
    for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append((r.fp % (1 << 64), r.component_id))
    fps = [plain_fp(r[1]) for r in rows]
    want = {}
    for r, f, c in zip(rows, fps, plain_components([r[0] for r in rows], fps)):
        want.setdefault(r[0], []).append((f, c))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def codes_near(rnd, n):
    out = {rnd.getrandbits(64) for _ in range(n)}
    for c in list(out)[: n // 2]:
        for _ in range(4):
            c ^= 1 << rnd.randrange(64)
            out.add(c)
    return np.array(sorted(out), np.uint64)


def test_index_finds_every_pair():
    rnd = random.Random(1)
    codes = codes_near(rnd, 150)
    keys = np.array([rnd.randrange(3) for _ in codes])
    index = simhash.GrayIndex(keys, codes)
    for radius in (0, 1, 3, 8):
        got = {(int(a), int(b)) for i, j in index.pairs(radius) for a, b in zip(i, j)}
        want = {(i, j) for i in range(index.n) for j in range(i + 1, index.n) if index.keys[i] == index.keys[j] and (int(index.codes[i]) ^ int(index.codes[j])).bit_count() <= radius}
        assert got == want


def test_any_segments_and_dense_groups_give_the_same_components(spark):
    rnd = random.Random(2)
    codes = set(codes_near(rnd, 60).tolist())
    centre = rnd.getrandbits(64)
    for _ in range(400):  # one dense group
        codes.add(centre ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randrange(5))}))
    codes = sorted(codes)
    want = plain_components(codes, codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fp long").cache()
    for blocks in (4, 5, 6):
        reach = dict(simhash.components(spark, simhash.links(df, 3, blocks)).collect())
        root = [reach.get(c, c) for c in signed]
        assert len(set(zip(root, want))) == len(set(root)) == len(set(want))


def test_chain_reaches_its_least_member(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(spark, edges).collect()} == {(i, 0) for i in range(201)}
