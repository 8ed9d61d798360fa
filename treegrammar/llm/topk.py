"""Exact top-k inner products on a bit-sliced index.

Vectors are quantised to integers and kept in blocks of rows; in a block every component is a set of bitmaps, one a bit
(slices), of its distance above the block's least value, and likewise below its greatest.  A query adds |q| times one of
the two for each component: one slice for each set bit of |q|, all of a weight summed with carry-save adders, so that the
sum's slices order the block's rows as the inner product does, up to a constant.  The best rows are selected from the most
significant slice downward; rows level at the boundary are resolved exactly, by the smaller id.  Blocks of queries meet
blocks of rows (the queries are a stated set), and each query keeps k rows a block before the blocks' answers are merged.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows without an
id; rows with the same id count as the query's own and are no candidates for it, and a repeated query id is answered once
for its least vector; repeated candidate rows each count; vectors of another length than the query's are no candidates; components or
scores that 64 bits cannot hold are an error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treegrammar.llm.common import batch, cut, read

ROWS, QUERIES, TOGETHER = 1 << 16, 64, 128  # rows of a block at most, queries of a block, query blocks of a set
VALUES = 1 << 22  # components of a block at most
SALTS = 16  # all vectors may have one length: blocks are dealt further


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v): whole-number components of the vectors that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def blocked(rows: DataFrame, size: int, together: int = 1) -> DataFrame:
    """(block, dims, width, ids, data): rows packed into blocks of up to size rows and VALUES components of one length, components in the fewest bytes that hold them. block names every run of together blocks of a task."""
    schema = pa.schema([("block", pa.string()), ("dims", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])

    def run(batches):
        held: dict[int, list] = {}
        task, made = TaskContext.get().partitionId(), dict[int, int]()

        def pack(d):
            ids, data = zip(*held.pop(d))
            data = np.concatenate(data)
            most = max(int(data.max()), -1 - int(data.min()))
            width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
            made[d] = made.get(d, -1) + 1
            return batch(schema, block=[f"{task}-{d}-{made[d] // together}"], dims=[d], width=[width], ids=[np.concatenate(ids).astype("<i8").tobytes()], data=[data.astype(f"<i{width}").tobytes()])

        for b in batches:
            ids, v = b.column(0).to_numpy(), b.column(1)
            flat, at = v.flatten().to_numpy(), np.append(0, np.cumsum(v.value_lengths().to_numpy()))
            length = np.diff(at)
            if len(flat) and (flat.max() >= 1 << 62 or flat.min() <= -(1 << 62)):
                raise OverflowError("a component is too large for whole numbers of 64 bits")
            for d in np.unique(length).tolist():
                which = np.flatnonzero(length == d)
                most = max(1, min(size, VALUES // d))
                for i in range(0, len(which), most):
                    part = which[i : i + most]
                    have = sum(len(x) for x, _ in held.get(d, []))
                    if have + len(part) > most:
                        yield pack(d)
                    held.setdefault(d, []).append((ids[part], flat[(at[part][:, None] + np.arange(d)).ravel()]))
        for d in list(held):
            yield pack(d)

    return rows.mapInArrow(run, "block string, dims int, width int, ids binary, data binary")


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["data"], f"<i{row['width']}").astype(np.int64).reshape(-1, row["dims"])


class BitSliced:
    """The slices of one block of rows."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        order = np.argsort(ids, kind="stable")  # bit order is id order: ties go to the smaller id
        self.ids, self.data = ids[order], data[order]
        self.low, self.high = self.data.min(axis=0), self.data.max(axis=0)
        self.n = len(ids)
        self.words = (self.n + 63) // 64
        self.above = [self.slices(self.data[:, j] - self.low[j]) for j in range(data.shape[1])]
        self.below = [self.slices(self.high[j] - self.data[:, j]) for j in range(data.shape[1])]

    def bitmap(self, bits: np.ndarray) -> np.ndarray:
        raw = np.packbits(bits, bitorder="little").tobytes()
        return np.frombuffer(raw.ljust(8 * self.words, b"\0"), "<u8").copy()

    def slices(self, values: np.ndarray) -> list[np.ndarray]:
        return [self.bitmap((values >> k & 1).astype(np.uint8)) for k in range(int(values.max(initial=0)).bit_length())]

    def total(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least first, of the sum over components: inner product less a constant of the query."""
        weights: list[list[np.ndarray]] = [[]]

        def put(weight, x):
            while len(weights) <= weight:
                weights.append([])
            weights[weight].append(x)

        for j, q in enumerate(query.tolist()):
            own = self.above[j] if q > 0 else self.below[j]
            for b in range(abs(q).bit_length()):
                if abs(q) >> b & 1:
                    for k, s in enumerate(own):
                        put(b + k, s)
        out, w = [], 0
        while w < len(weights):
            column = weights[w]
            while len(column) > 2:  # three of a weight make one of it and one of the next
                x, y, z = column.pop(), column.pop(), column.pop()
                half = x ^ y
                put(w + 1, (x & y) | (half & z))
                column.insert(0, half ^ z)
            if len(column) == 2:
                x, y = column
                put(w + 1, x & y)
                column = [x ^ y]
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            w += 1
        return out

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own, ties to the smaller id."""
        span = [max(abs(int(a)), abs(int(b))) for a, b in zip(self.low, self.high)]
        if sum(a * abs(q) for a, q in zip(span, query.tolist())) >= 1 << 62:
            raise OverflowError("a score is too large for whole numbers of 64 bits")
        total = self.total(query)
        open_ = self.bitmap((self.ids != query_id).astype(np.uint8))
        sure, left = np.zeros(self.words, np.uint64), k
        if int(np.bitwise_count(open_).sum()) <= k:
            sure, open_ = open_, sure
        else:
            for s in reversed(total):
                ones = open_ & s
                n = int(np.bitwise_count(ones).sum())
                if n > left:
                    open_ = ones
                else:
                    sure, open_, left = sure | ones, open_ & ~s, left - n
                if not left:
                    break
        rows = self.positions(sure)
        if left:  # all that is open is level
            rows = np.append(rows, self.positions(open_)[:left])
        return self.ids[rows], self.data[rows] @ query

    def positions(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors for each row of queries."""
    spark = vectors.sparkSession
    rows = cut(spark, blocked(quantised(vectors, id_col, vector_col, scale), ROWS), "row-blocks")
    asked = quantised(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = cut(spark, blocked(asked, QUERIES, TOGETHER).withColumnRenamed("block", "set"), "query-blocks")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(held: pa.Table, sets: pa.Table) -> pa.Table:
        out = []
        for block in held.to_pylist():  # one
            index = BitSliced(*unpacked(block))
            for r in sets.to_pylist():
                for q, v in zip(*unpacked(r)):
                    ids, score = index.best(int(q), v, k)
                    out.append(batch(schema, query_id=np.full(len(ids), q), vec_id=ids, score=score))
        return pa.Table.from_batches(out, schema)

    # a block of rows is sent once for each set of queries, a query once to each block of rows; few names meet many blocks
    def met(many: DataFrame, few: DataFrame, *by: str) -> DataFrame:
        salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
        return many.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS))).join(few.select("*", salt), ["dims", "salt"]).drop("salt")

    held = met(rows, asked.select("dims", "set").distinct(), "block")
    sets = met(asked, rows.select("dims", "block"), "ids").select(F.col("dims").alias("q_dims"), F.col("set").alias("q_set"), "width", "ids", "data", F.col("block").alias("q_block")).withColumnRenamed("q_dims", "dims")
    found = held.groupBy("block", "set").cogroup(sets.groupBy("q_block", "q_set")).applyInArrow(run, "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM (SELECT vec_id, min(v) AS v FROM good WHERE vec_id % 50 = 0 GROUP BY vec_id) q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 5
"""
