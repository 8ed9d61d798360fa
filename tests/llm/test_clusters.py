import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from treegrammar.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, block string"


def plain(rows, k=8, rounds=10, dims=64):
    """The definition, in plain loops: every distance of every round."""
    ok = [(i, [math.floor(1024 * x) for x in e]) for i, e, *_ in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    ok.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in ok[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        got = {}
        for _, v in ok:
            got.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(got[j]) for x in zip(*got[j])] if j in got else c for j, c in enumerate(cents)]
    found = [(i, *near(v)) for i, v in ok]
    own = {}
    for _, d, j in found:
        own[j] = own.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, own[j], sum(own.values()), sha[j]) for i, d, j in found), key=repr)


def some(n, seed=1, scale=1.0):
    rnd = random.Random(seed)
    at = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [round((x + rnd.gauss(0, 0.4)) * scale, 2) for x in rnd.choice(at)], 1, "x", "y") for i in range(n)]


def query(spark, tmp_path, rows, name):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / name / "embeddings.parquet"))
    return clusters.op13_sort_means(spark, str(tmp_path / name)), str(tmp_path / name / "embeddings.parquet/*.parquet")


def test_against_the_definition_and_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 17)
    rows = some(150) + [(500 + i, [0.25] * 64, 1, "x", "y") for i in range(9)]
    rows += [(900, None, 1, "x", "y"), (901, [None] * 64, 1, "x", "y"), (902, [float("nan")] * 64, 1, "x", "y"), (903, [1.0] * 63, 1, "x", "y"), (904, [], 1, "x", "y"), (None, [0.5] * 64, 1, "x", "y"), (7, [0.125] * 64, 1, "x", "y"), (7, [0.125] * 64, 1, "x", "y")]
    tables = len(spark.catalog.listTables())
    df, path = query(spark, tmp_path, rows, "t")
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    sql = con.execute(clusters.ORACLE)
    assert [c[0] for c in sql.description] == df.columns and sorted(sql.fetchall(), key=repr) == got
    assert len(spark.catalog.listTables()) == tables


def test_few_rows_large_numbers_and_none(spark, tmp_path):
    for name, rows in (("few", some(3)), ("same", [(i, [0.5] * 64, 1, "x", "y") for i in range(20)]), ("large", some(40, scale=1e4))):
        assert sorted(map(tuple, query(spark, tmp_path, rows, name)[0].collect()), key=repr) == plain(rows), name
    none = query(spark, tmp_path, [(1, None, 1, "x", "y")], "none")[0]
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="too large"):
        query(spark, tmp_path, [(1, [1e300] * 64, 1, "x", "y"), (2, [0.0] * 64, 1, "x", "y")], "huge")[0].collect()


def test_scan_stops_only_where_it_may():
    rnd = np.random.default_rng(5)
    for scale in (2, 5, 1000):
        v, c = rnd.integers(-scale, scale, (400, 4)), rnd.integers(-scale, scale, (9, 4))
        c[6] = c[2]
        far = ((v[:, None] - c[None]) ** 2).sum(2)
        for start in (np.zeros(400, int), rnd.integers(0, 9, 400)):
            near, d = clusters.Order(c.tolist()).assign(v, start)
            assert (near == far.argmin(1)).all() and (d == far.min(1)).all()


def test_rounds_move_no_vectors(spark):
    tables = clusters.Buckets(spark, "block")
    rows = spark.createDataFrame(some(50), SCHEMA)
    blocks = tables.put(clusters.blocked(clusters.kept(rows, "vec_id", "embedding", 64, 1024.0)))
    now = tables.put(clusters.round_of(blocks.selectExpr("*", "cast(null as binary) had"), clusters.Order([[0] * 64, [9] * 64]), 64))
    plan = blocks.join(now.select("block", "had").hint("shuffle_hash"), "block")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    tables.drop()
