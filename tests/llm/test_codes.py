import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from treegrammar.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, v string"


def plain(rows, rounds=6):
    """The definition, in plain loops."""
    ok = [(i, e, lab, [math.floor(4096 * x) for x in e]) for i, e, lab, *_ in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    d = len(ok[0][3]) // 8
    pieces = [[v[p * d : p * d + d] for p in range(8)] for *_, v in ok]
    books = [[list(v[p]) for v in pieces[:16]] for p in range(8)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            got = {}
            for v in pieces:
                got.setdefault(near(v[p], books[p])[1], []).append(v[p])
            for k, xs in got.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by_label = [], {}
    for (i, _, lab, _), v in zip(ok, pieces):
        found = [near(v[p], books[p]) for p in range(8)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), lab))
        by_label[lab] = by_label.get(lab, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, by_label[lab], sha) for i, c, e, lab in out), key=repr)


def some(n, dims=16, seed=1, scale=1.0):
    rnd = random.Random(seed)
    return [(i, [round(rnd.gauss(0, 1) * scale, 2) for _ in range(dims)], rnd.choice([1, 2, None]), "x", "y") for i in range(n)]


def query(spark, tmp_path, rows, name="t", parts=3):
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(str(tmp_path / name / "embeddings.parquet"))
    return codes.op12_vector_codes(spark, str(tmp_path / name)), str(tmp_path / name / "embeddings.parquet/*.parquet")


def test_against_the_definition_and_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(codes, "ROWS", 30)
    rows = some(120) + [(500 + i, [0.25] * 16, 3, "x", "y") for i in range(9)]
    rows += [(900, None, 1, "x", "y"), (901, [None] * 16, 1, "x", "y"), (902, [float("nan")] * 16, 1, "x", "y"), (903, [float("-inf")] * 16, 1, "x", "y"), (None, [0.5] * 16, 1, "x", "y"), (7, [0.125] * 16, 1, "x", "y"), (7, [0.125] * 16, 1, "x", "y")]
    df, path = query(spark, tmp_path, rows)
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    sql = con.execute(codes.ORACLE)
    assert [c[0] for c in sql.description] == df.columns and sorted(sql.fetchall(), key=repr) == got


def test_few_rows_large_numbers_and_other_lengths(spark, tmp_path):
    few = some(5, dims=8)
    assert sorted(map(tuple, query(spark, tmp_path, few, "few")[0].collect()), key=repr) == plain(few)
    large = some(40, scale=1e4) + [(70, [3e5] * 16, 1, "x", "y")]  # beyond what is compared in 64 bits
    assert sorted(map(tuple, query(spark, tmp_path, large, "large")[0].collect()), key=repr) == plain(large)
    mixed = some(30) + [(50, [1.0] * 3, 1, "x", "y"), (51, [], 1, "x", "y")]
    got = {r.vec_id: r for r in query(spark, tmp_path, mixed, "mixed")[0].collect()}
    assert (got[50].code, got[50].error, got[51].code) == (None, None, None) and len(got) == 32
    assert sorted((tuple(r) for i, r in got.items() if i < 50), key=repr) == plain(some(30))
    odd = query(spark, tmp_path, [(1, [1.0] * 3, 1, "x", "y")], "odd")[0].collect()
    assert [(r.vec_id, r.code, r.error) for r in odd] == [(1, None, None)]
    assert query(spark, tmp_path, [], "none")[0].collect() == []
    with pytest.raises(Exception, match="too large"):
        query(spark, tmp_path, [(1, [1e300] * 8, 1, "x", "y"), (2, [0.0] * 8, 1, "x", "y")], "huge")[0].collect()


def test_bounds_never_exceed_distances_and_ties_go_to_the_lower_index():
    rnd = np.random.default_rng(3)
    for scale in (2, 50, 1 << 20):
        rows, entries = rnd.integers(-scale, scale, (60, 8)), rnd.integers(-scale, scale, (16, 8))
        entries[9] = entries[4]
        apart = ((rows[:, None] - entries[None]) ** 2).sum(2)
        mine, theirs = np.repeat(np.arange(60), 16), np.tile(np.arange(16), 60)
        last = None
        for size in codes.block_sizes(8):
            bound = codes.Level(rows, size).bound(codes.Level(entries, size), mine, theirs)
            assert (bound <= size * apart[mine, theirs]).all()
            last = bound / size if last is None else last
        best, far = codes.nearest(rows, entries)
        assert (best == apart.argmin(1)).all() and (far == apart.min(1)).all()
        again = codes.nearest_of_any_size(rows, entries)
        assert (best == again[0]).all() and (far == again[1]).all()
    assert codes.block_sizes(8) == [8, 4, 2] and codes.block_sizes(3) == [3] and codes.block_sizes(1) == [1]


def test_decoded(spark):
    df = spark.createDataFrame(some(60), SCHEMA)
    out, books = codes.compress(df)
    rows = {r.vec_id: r for r in codes.decoded(out, books).collect()}
    for i, e, *_ in some(60):
        v = [math.floor(4096 * x) for x in e]
        assert sum((a - b) ** 2 for a, b in zip(v, rows[i].v)) == rows[i].error
