import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from treegrammar.llm import mixing

SCHEMA = "doc_id long, text string, source string, rank string, offset int"


def filled(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, free, out = share * sum(sizes.values()), set(order), {}
    while True:
        left = total - sum(cap * sizes[s] for s in order if s not in free)
        whole = sum(weight[s] for s in free)
        out = {s: left * weight[s] / whole if s in free else cap * sizes[s] for s in order}
        over = {s for s in free if out[s] > cap * sizes[s] + 1e-9}
        if not over:
            return out
        free -= over


def rows():
    out = [(i, "w\t" * (i * 37 % 91), f"s{i % 5}", "r", 1) for i in range(300)]
    out += [(1000 + i, "A b\nc", None, "r", 2) for i in range(7)] + [(5, None, "s1", "r", 0), (6, "", "tiny", "r", 0), (7, "lone", "one", "r", 0)]
    return out + [(8, "long " * 9000, "s0", "r", 0), (9, "same", "s2", "r", 0), (9, "same", "s2", "r", 0), (None, "no id", "s3", "r", 0)]


@pytest.fixture(scope="module")
def mixed(spark):
    at, pieces = mixing.mix(spark.createDataFrame(rows(), SCHEMA), block_words=16, shard_words=500)
    return at.collect(), pieces.collect()


def test_targets_and_taken(mixed):
    at, pieces = mixed
    sizes = defaultdict(int)
    for _, text, source, *_ in rows():
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    goal = filled(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    taken = defaultdict(int)
    of = {(r["rank"], r["offset"]): r["size"] for r in at if r["size"]}
    assert len(of) == sum(bool((r[1] or "").split()) for r in rows()) and len(at) == len(rows())
    by_doc = defaultdict(int)
    for p in pieces:
        taken[p["rank"]] += p["words"]
        by_doc[p["rank"], p["offset"]] += p["words"]
        assert 0 <= p["first"] and p["first"] + p["words"] <= of[p["rank"], p["offset"]]
    assert all(n <= 2 * of[k] for k, n in by_doc.items())
    for rank, s in enumerate(order):
        assert abs(taken[rank] - goal[s]) <= 16
    for r in at:
        assert r["target"] == pytest.approx(goal[order[r["rank"]]]) and r["source_size"] == sizes[order[r["rank"]]]


def test_a_pass_takes_no_word_twice_and_shards_differ(mixed):
    _, pieces = mixed
    seen = defaultdict(list)
    for p in pieces:
        seen[p["rank"], p["offset"], p["epoch"]].append((p["first"], p["words"]))
    for ranges in seen.values():
        ranges.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(ranges, ranges[1:]))
    assert len({p["shard"] for p in pieces}) > 5


def test_permutations(spark):
    for n in (1, 2, 3, 7, 100, 1000):
        got = spark.range(n).select(F.expr(mixing.permuted("id", f"{n}L", "7, 1L, 0L")).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))
        assert n < 100 or [r.p for r in got] != list(range(n))


def test_reruns_agree_and_empty(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    runs = [sorted(map(tuple, mixing.mix(df.repartition(k), block_words=16)[1].drop("shard").collect())) for k in (2, 5)]
    assert runs[0] == runs[1]
    at, pieces = mixing.mix(df.limit(0))
    assert at.count() == pieces.count() == 0


def test_texts(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = mixing.mixed_texts(df, block_words=16)
    assert out.columns == df.columns
    words = defaultdict(list)
    for _, text, source, *_ in rows():
        words[source].append((text or "").split())
    got = defaultdict(int)
    for r in out.collect():
        got[r["source"]] += len((r["text"] or "").split())
    goal = filled({s: sum(map(len, w)) for s, w in words.items()})
    assert all(abs(got[s] - goal[s]) <= 16 for s in goal)


def test_shards_are_filled_by_a_permutation_of_all_slots(spark, mixed):
    at, pieces = mixed
    plan = {}
    for r in at:
        if r["source_size"]:
            want = min(round(r["target"]), 2 * r["source_size"])
            passes, rest = divmod(want, r["source_size"])
            plan[r["rank"]] = passes * -(-r["source_size"] // 16) + -(-rest // 16)
    n = sum(plan.values())
    per = 500 // 16
    place = [r.p for r in spark.range(n).select(F.expr(mixing.permuted("id", f"{n}L", "7, -1L, -1L")).alias("p")).collect()]
    want, g = defaultdict(int), 0
    for rank in sorted(plan):
        for _ in range(plan[rank]):
            want[rank, place[g] // per] += 1
            g += 1
    got = defaultdict(set)
    for p in pieces:
        got[p["rank"], p["shard"]].add((p["epoch"], p["block"]))
    assert {k: len(v) for k, v in got.items()} == dict(want)
    sizes = defaultdict(int)
    for (_, shard), k in want.items():
        sizes[shard] += k
    assert all(sizes[s] == per for s in range(n // per))
