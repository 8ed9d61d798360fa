"""Centroid clustering in whole numbers by sort-means.

Vectors are packed into blocks of one table, bucketed by block.  In each round every centroid's others are ordered by their
distance from it; a vector's scan begins at the centroid it had before and stops at the first other centroid that lies
strictly beyond twice the vector's present distance, because neither it nor any later one can be nearer or as near.  A
round reads the blocks beside their former numbers (a table of a few bytes a vector in the same buckets, so that the join
moves no vectors), writes the new numbers with each block's sums, and sends only sums (clusters x components) to the driver.

Defined results: only vectors with exactly `dims` components take part, none of them null or non-finite; rows with a null
or repeated id take part as rows of their own (first centroids: null ids last, ties by the vector).  Fewer rows than
clusters give as many clusters; clusters that get no vector keep their centroid.  Components, distances or sums that 64
bits cannot hold are an error.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treegrammar.llm.codes import Sums, finite, matrix, nearest_of_any_size, safe, totals, whole
from treegrammar.llm.common import Buckets, batch, cut, read

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024.0, 3
BLOCK = 1024  # vectors of a block


def kept(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: float) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    good = finite(F.col(vector_col)) & (F.size(vector_col) == dims)
    return vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector_col), scale).alias("v"))


def blocked(rows: DataFrame) -> DataFrame:
    """(block, ids, width, data): vectors of a task, components in the fewest bytes that hold them."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("data", pa.binary())])

    def run(batches):
        name = TaskContext.get().partitionId() << 32
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                v = matrix(part.column(1))
                most = max(int(v.max(initial=0)), -1 - int(v.min(initial=0)))
                width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
                yield batch(schema, block=[name], ids=[part.column(0)], width=[width], data=[v.astype(f"<i{width}").tobytes()])
                name += 1

    return rows.mapInArrow(run, "block long, ids array<long>, width int, data binary")


class Order:
    """Centroids, and for each of them the others by their distance from it."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64)
        k = len(centroids)
        apart = [[sum((a - b) ** 2 for a, b in zip(x, y)) for y in centroids] for x in centroids]
        self.others = [sorted((j for j in range(k) if j != i), key=lambda j: (apart[i][j], j)) for i in range(k)]
        self.apart = [[apart[i][j] for j in self.others[i]] for i in range(k)]

    def assign(self, v: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid (ties: the smaller number) and the squared distance of each vector; before: where its scan begins."""
        if not safe(v, self.centroids):
            return nearest_of_any_size(v, self.centroids)
        near, far = before.astype(np.int64), np.zeros(len(v), np.int64)
        for at in np.unique(before).tolist():
            mine = np.flatnonzero(before == at)
            apart = v[mine] - self.centroids[at]
            present = (apart * apart).sum(axis=1)
            best, least = np.full(len(mine), at), present.copy()
            left = np.arange(len(mine))  # vectors whose scan goes on
            for other, square in zip(self.others[at], self.apart[at]):
                left = left[4 * present[left] >= square]
                if not len(left):
                    break
                apart = v[mine[left]] - self.centroids[other]
                d = (apart * apart).sum(axis=1)
                nearer = (d < least[left]) | ((d == least[left]) & (other < best[left]))
                best[left[nearer]], least[left[nearer]] = other, d[nearer]
            near[mine], far[mine] = best, least
        return near, far


_SUMS = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]))


def vectors_of(width: int, data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(-1, dims)


def round_of(joined: DataFrame, order: Order, dims: int) -> DataFrame:
    """(block, had, sums): the numbers of a block's vectors (four bytes each) and the sums of its clusters."""
    schema = pa.schema([("block", pa.int64()), ("had", pa.binary()), ("sums", _SUMS)])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                v = vectors_of(row["width"], row["data"], dims)
                before = np.frombuffer(row["had"], "<i4") if row["had"] else np.zeros(len(v), np.int32)
                near, _ = order.assign(v, before)
                got = Sums()
                for c in np.unique(near).tolist():
                    got.add(c, v[near == c])
                each = [{"cluster": c, "n": n, "high": high.tolist(), "low": low.tolist()} for c, (n, high, low) in got.held.items()]
                yield batch(schema, block=[row["block"]], had=[near.astype("<i4").tobytes()], sums=[each])

    return joined.select("block", "width", "data", "had").mapInArrow(run, "block long, had binary, sums array<struct<cluster:int,n:long,high:array<long>,low:array<long>>>")


def settled(joined: DataFrame, order: Order, dims: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                v = vectors_of(row["width"], row["data"], dims)
                before = np.frombuffer(row["had"], "<i4") if row["had"] else np.zeros(len(v), np.int32)
                near, far = order.assign(v, before)
                yield batch(schema, vec_id=row["ids"], cluster=near, distance=far)

    return joined.select("ids", "width", "data", "had").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every vector as a written table, the final centroids)."""
    spark = vectors.sparkSession
    rows = kept(vectors, id_col, vector_col, dims, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    centroids = [r.v for r in rows.orderBy(F.asc_nulls_last(key), "v").limit(k).collect()]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    tables = Buckets(spark, "block")
    blocks = tables.put(blocked(rows))
    joined = blocks.withColumn("had", F.lit(None).cast("binary"))
    for i in range(rounds):
        now = tables.put(round_of(joined, Order(centroids), dims))
        joined = blocks.join(now.select("block", "had").hint("shuffle_hash"), "block")
        for (c,), (n, s) in totals(now.select(F.explode("sums").alias("s")).select("s.*"), "cluster").items():
            centroids[c] = [x // n for x in s]
        tables.drop(1, -1)
    out = cut(spark, settled(joined, Order(centroids), dims), "clusters")
    tables.drop()
    return out, centroids


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    import hashlib

    out, centroids = cluster(read(spark, sf_dir, "embeddings"))
    sums = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    if any(s >= 1 << 63 for s in (sum(sums.values()), 0)):
        raise OverflowError("an inertia is too large for whole numbers of 64 bits")
    inertia = F.array(*(F.lit(sums.get(c, 0)).cast("long") for c in range(len(centroids)))).cast("array<long>")
    named = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids)).cast("array<string>")
    return out.select("vec_id", "cluster", "distance", F.get(inertia, "cluster").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), F.get(named, "cluster").alias("centroid_sha256"))


def oracle() -> str:
    """Every round in full: all distances of all vectors."""
    rounds = 10
    steps = ["""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, embedding) AS r, vec_id,
    list_transform(embedding, lambda x: floor(1024.0 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT r - 1 AS e, v AS c FROM kept WHERE r <= 8)"""]
    near = """
a{i} AS (
  SELECT r, first(v) AS v, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT r, v, e, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM kept, c{i}) GROUP BY r)"""
    mean = """
m{i} AS (
  SELECT e, list(m ORDER BY k) AS c FROM (
    SELECT e, k, ((sum(x)::HUGEINT - ((sum(x)::HUGEINT % count(*) + count(*)) % count(*))) // count(*))::BIGINT AS m
    FROM (SELECT best.e AS e, unnest(v) AS x, unnest(range(64)) AS k FROM a{i}) GROUP BY e, k) GROUP BY e),
c{j} AS (SELECT c{i}.e, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.e = m{i}.e)"""
    for i in range(rounds):
        steps += [near.format(i=i), mean.format(i=i, j=i + 1)]
    steps.append(near.format(i=rounds))
    tail = f"""
SELECT vec_id, best.e::INTEGER AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.e))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} ON kept.r = a{rounds}.r JOIN c{rounds} ON best.e = c{rounds}.e
"""
    return ",".join(steps) + tail


ORACLE = oracle()
