"""Vector code compression: vectors are cut into parts, and each part is written as the number of its codebook's nearest entry.

Codebooks are learned by rounds over all vectors in whole numbers.  In each round a task assigns its parts and sums what
every entry got; only these sums (parts x entries x components) leave it, and only they and the codebooks reach the driver.
A part's entries are filtered from coarse to fine: a part's blocks of 8, 4 and 2 components are known by their sums and by
the norm of what is left of them, and the squared distance is at least

    sum over blocks of (difference of sums)^2 / block size  +  (difference of the residuals' norms)^2,

so that entries whose bound is beyond a distance already found are out; all others get exact distances in whole numbers.
Bounds are kept conservative: the first term is compared as a whole number, norms are rounded apart.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; all others are kept, also
those with a null id (which sorts last) or a repeated one (ties by the vector).  The first kept row in that order says how
long vectors are; rows of another length, and all rows where that is zero or no multiple of the parts, get no code and no
error.  Fewer kept rows than entries give as many entries.  Components, distances or sums that 64 bits cannot hold are an
error.  An empty table gives an empty result; null labels are one label; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treegrammar.llm.common import batch, cut, read

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
ROWS = 4096  # rows whose parts are compared at once
SALTS = 64  # a label may hold most rows: they are dealt to so many groups


def whole(vector: Column, scale: float) -> Column:
    """array<long>: floor(scale x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)))


def finite(vector: Column) -> Column:
    """The vector is not null, and no component is null or not finite."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length."""
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    if v.size and (int(v.max()) >= 1 << 62 or int(v.min()) <= -(1 << 62)):
        raise OverflowError("a component is too large for whole numbers of 64 bits")
    return v


def root(square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers at most and at least the square root."""
    r = np.sqrt(square.astype(np.float64))
    return np.floor(r * (1 - 1e-12)), np.ceil(r * (1 + 1e-12))


class Level:
    """Block sums, and bounds of the residuals' norms, of rows at one block size."""

    def __init__(self, rows: np.ndarray, size: int):
        blocks = rows.reshape(len(rows), -1, size)
        self.sums = blocks.sum(axis=2)
        self.low, self.high = root(size * (rows * rows).sum(axis=1) - (self.sums * self.sums).sum(axis=1))  # of size x norm^2

    def bound(self, other: Level, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """size x a lower bound of the squared distances of these pairs of rows."""
        apart = self.sums[mine] - other.sums[theirs]
        gap = np.maximum(np.maximum(self.low[mine] - other.high[theirs], other.low[theirs] - self.high[mine]), 0)
        return (apart * apart).sum(axis=1) + np.floor(gap * gap * (1 - 1e-12)).astype(np.int64)


def block_sizes(d: int) -> list[int]:
    """The whole part, its halves, their halves ... down to blocks of two components."""
    sizes = [d]
    while sizes[-1] % 2 == 0 and sizes[-1] > 2:
        sizes.append(sizes[-1] // 2)
    return sizes


def safe(rows: np.ndarray, others: np.ndarray) -> bool:
    """Squares of sums of differences fit into 64 bits."""
    most = max(int(rows.max(initial=0)), -int(rows.min(initial=0)), int(others.max(initial=0)), -int(others.min(initial=0)))
    return (2 * most * rows.shape[1]) ** 2 < 1 << 62


def nearest_of_any_size(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest() in numbers without bound, for the rare large ones."""
    best, least = [], []
    for row in rows.tolist():
        far = [sum((a - b) ** 2 for a, b in zip(row, entry)) for entry in entries.tolist()]
        best.append(far.index(min(far)))
        least.append(min(far))
    if max(least, default=0) >= 1 << 63:
        raise OverflowError("a distance is too large for whole numbers of 64 bits")
    return np.array(best, np.int64), np.array(least, np.int64)


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (ties: the lower index) and the squared distance of each row."""
    if not safe(rows, entries):
        return nearest_of_any_size(rows, entries)
    n, k = len(rows), len(entries)
    mine, theirs = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    least = None
    for size in block_sizes(rows.shape[1]):
        bound = (own := Level(rows, size)).bound(Level(entries, size), mine, theirs)
        if least is None:  # the distance to the entry of the least bound is one that the nearest doesn't exceed
            guess = np.argmin(bound.reshape(n, k), axis=1)
            apart = rows - entries[guess]
            least = (apart * apart).sum(axis=1)
        stay = bound <= size * least[mine]
        mine, theirs = mine[stay], theirs[stay]
    apart = rows[mine] - entries[theirs]
    far = np.full((n, k), np.iinfo(np.int64).max)
    far[mine, theirs] = (apart * apart).sum(axis=1)
    best = np.argmin(far, axis=1)  # the first of equal ones
    return best, far[np.arange(n), best]


def assigned(v: np.ndarray, books: np.ndarray):
    """For each part: its vectors' pieces, their entries and squared distances. books: parts x entries x components."""
    d = books.shape[2]
    for p, book in enumerate(books):
        rows = np.ascontiguousarray(v[:, p * d : (p + 1) * d])
        found = [nearest(rows[i : i + ROWS], book) for i in range(0, len(rows), ROWS)]
        yield rows, np.concatenate([b for b, _ in found]), np.concatenate([e for _, e in found])


def as_numbers(values: list) -> np.ndarray:
    """Codebooks as 64-bit numbers; entries are means of such."""
    return np.array(values, np.int64)


class Sums:
    """Counts and componentwise sums of rows by key, in two words (sum = high * 2^31 + low), so that none overflows."""

    def __init__(self):
        self.held: dict = {}

    def add(self, key, rows: np.ndarray) -> None:
        n, high, low = self.held.get(key, (0, 0, 0))
        self.held[key] = n + len(rows), high + (rows >> 31).sum(axis=0), low + (rows & 0x7FFFFFFF).sum(axis=0)


def totals(each: DataFrame, *keys: str) -> dict[tuple, tuple[int, list[int]]]:
    """key -> (count, sums) from rows (keys, n, high, low) of tasks; what reaches the driver is keys x components."""
    flat = each.select(*keys, "n", "high", "low", F.explode(F.sequence(F.lit(0), F.size("high") - 1)).alias("at"))
    total = F.expr("cast(high[at] as decimal(38,0)) * 2147483648 + low[at]")
    flat = flat.groupBy(*keys, "at").agg(F.sum("n").alias("n"), F.sum(total).alias("s"))
    out: dict = {}
    for *key, _, n, s in sorted(map(tuple, flat.collect())):
        out.setdefault(tuple(key), (n, []))[1].append(int(s))
    return out


def sums(rows: DataFrame, books: np.ndarray) -> dict[tuple, tuple[int, list[int]]]:
    """(part, entry) -> (count, componentwise sums), over all rows; a row for each task, part and entry is shuffled."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])

    def run(batches):
        got = Sums()
        for b in batches:
            if b.num_rows:
                for p, (own, entry, _) in enumerate(assigned(matrix(b.column(0)), books)):
                    for e in np.unique(entry).tolist():
                        got.add((p, e), own[entry == e])
        if got.held:
            n, high, low = zip(*got.held.values())
            yield batch(schema, part=[p for p, _ in got.held], entry=[e for _, e in got.held], n=n, high=[x.tolist() for x in high], low=[x.tolist() for x in low])

    return totals(rows.select("v").mapInArrow(run, "part int, entry int, n long, high array<long>, low array<long>"), "part", "entry")


def learned(rows: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after so many rounds; entries that got nothing stay."""
    for _ in range(rounds):
        new = books.tolist()
        for (p, e), (n, s) in sums(rows, books).items():
            new[p][e] = [x // n for x in s]
        books = as_numbers(new)
    return books


def first_entries(rows: DataFrame, entries: int, parts: int) -> np.ndarray:
    """The parts of the first rows in id order."""
    got = [r.v for r in rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    return as_numbers([[v[p * len(v) // parts : (p + 1) * len(v) // parts] for v in got] for p in range(parts)])


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error)."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            found = list(assigned(matrix(b.column(2)), books))
            error = sum((e for _, _, e in found), np.zeros(b.num_rows, np.int64))
            if (sum(e.astype(np.float64) for _, _, e in found) > 9.2e18).any():
                raise OverflowError("an error is too large for whole numbers of 64 bits")
            hexed = np.stack([k for _, k, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            wide = 2 * len(books)
            yield batch(schema, vec_id=b.column(0), label=b.column(1), code=[hexed[i * wide : (i + 1) * wide] for i in range(b.num_rows)], error=error)

    return rows.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label as text, code, error) of all kept rows, and the codebooks (parts x entries x components)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part")
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    kept = vectors.where(finite(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), whole(F.col(vector_col), scale).alias("v"))
    kept = cut(vectors.sparkSession, kept, "whole-vectors")
    first = kept.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).collect()
    dims = len(first[0].v) if first and len(first[0].v) % parts == 0 else 0
    if not dims:
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    same = kept.where(F.size("v") == dims)
    books = learned(same, first_entries(same, entries, parts), rounds)
    other = kept.where(F.size("v") != dims).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded(same, books).union(other), books


def decoded(codes: DataFrame, books: np.ndarray, code_col: str = "code") -> DataFrame:
    """codes with a column v: the entries that a code names, part after part (null for no code)."""
    table = F.array(*(F.array(*(F.array(*map(F.lit, e)) for e in book)) for book in books.tolist()))
    number = lambda p: F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")
    pieces = [F.get(F.get(table, F.lit(p)), number(p)) for p in range(len(books))]
    return codes.withColumn("v", F.when(F.col(code_col).isNotNull(), F.concat(*pieces)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256)."""
    out, books = compress(read(spark, sf_dir, "embeddings"))
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    out = cut(spark, out.withColumn("salt", salt), "vector-codes")
    groups = out.groupBy("label", "salt").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))  # no more than SALTS a label
    groups = groups.select(F.col("label").alias("of"), F.col("salt").alias("at"), F.sum("s").over(Window.partitionBy("label")).cast("long").alias("label_error"))
    named = out.join(groups, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at")))
    text = ",".join(str(x) for x in books.ravel().tolist())
    return named.select("vec_id", "code", "error", "label_error", F.sha2(F.lit(text).cast("binary"), 256).alias("codebooks_sha256"))


def oracle() -> str:
    """Every round in full: all distances, no bounds."""
    rounds = 6
    head = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: floor(4096.0 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
piece AS (SELECT r, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS v FROM kept, range(8) t(p)),
b0 AS (SELECT p, r - 1 AS e, v AS c FROM piece WHERE r <= 16)"""
    near = """
a{i} AS (
  SELECT r, p, first(v) AS v, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT r, piece.p, v, e, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d
    FROM piece JOIN b{i} ON piece.p = b{i}.p) GROUP BY r, p)"""
    mean = """
s{i} AS (
  SELECT p, e, list(m ORDER BY k) AS c FROM (
    SELECT p, e, k, ((sum(x)::HUGEINT - ((sum(x)::HUGEINT % count(*) + count(*)) % count(*))) // count(*))::BIGINT AS m
    FROM (SELECT p, best.e AS e, unnest(v) AS x, unnest(range(len(v))) AS k FROM a{i}) GROUP BY p, e, k) GROUP BY p, e),
b{j} AS (SELECT b{i}.p, b{i}.e, coalesce(s{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN s{i} ON b{i}.p = s{i}.p AND b{i}.e = s{i}.e)"""
    steps = [head]
    for i in range(rounds):
        steps += [near.format(i=i), mean.format(i=i, j=i + 1)]
    steps.append(near.format(i=rounds))
    tail = f"""
done AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r),
names AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN done ON kept.r = done.r, names
"""
    return ",".join(steps) + "," + tail


ORACLE = oracle()
