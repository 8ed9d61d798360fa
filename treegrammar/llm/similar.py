"""Groups of texts whose word-shingle sets have a Jaccard similarity of at least ``least``.

The least similarity bounds how many shingles two such texts can differ in, so that under one order of all shingles the
first n - ceil(least * n) + 1 of the one and of the other have a member in common (a prefix filter: no pair is missed).
Every text's prefix is dealt by shingle, as (shingle, text, size) and nothing else.  The order puts shingles that a sample of the
texts repeats last, which keeps common passages out of the prefixes; any order gives the same pairs.

Each text has a sketch, a row in a table of its own: its size, its SimHash fingerprint and the parity of its shingles in 512 slots,
and in as many slots as it has shingles.  Two texts differ in at least as many shingles as parities, which drops most pairs before
their sets are fetched and never one that is similar; the long parities, 48 times smaller than the sets, do that for long texts.  Sets
are made only for texts that a bitmap of fixed size lets through, so no text is shuffled.

What is left is verified by exact similarity in rounds, each among texts that are not yet in one component.  First each text meets one
leader (of its SimHash component, and of the smallest texts of fitting size in its shingles the one met most often).  Then, in PROBES rounds, texts meet a
neighbour in a random order of some of their shingles, a few for each text.  That joins large groups without looking at all their pairs.
At last all texts of a shingle that are still in different components are held against each other, so no pair is missed.

Texts are named by row; rows with the same name must hold the same text and count once.

Defined results: a null text is an empty text; texts without words are alike; texts shorter than a shingle are one shingle; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treegrammar.llm import simhash
from treegrammar.llm.common import batch, cut, forget, partitions
from treegrammar.llm.tokens import some

SAMPLE, SLOTS, OFTEN = 4000, 1 << 22, 4  # texts whose shingles are counted, slots of the counts, count from which a slot is common
PAIRS = 1 << 18  # pairs given out at once
BITS = 1 << 24  # of the bitmap of texts whose sets are wanted
PROBED, PROBES = 3, 1  # one of how many tokens is looked at in a round, and rounds
SET_BYTES = 6  # of each hash in the sets that are sent to be compared
PARITIES = tuple(f"m{i}" for i in range(8))  # of 64 slots each


def shingle_set(text: str | None, words: int, seed: int) -> np.ndarray:
    return np.unique(np.array(simhash.hashes(text, words, seed), np.uint64))


def fits(small, large, least: float):
    """Sizes of sets that can be so similar."""
    return small >= least * large - 1e-9


def prefix(shingles: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """common: how often each slot was seen."""
    n = len(shingles)
    if not n:
        return np.zeros(1, np.uint64)
    order = np.lexsort((shingles, common[(shingles % np.uint64(SLOTS)).astype(np.int64)]))
    return shingles[order[: n - math.ceil(least * n - 1e-9) + 1]]


def parities(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % 512, minlength=512) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def long_parities(shingles: np.ndarray) -> bytes:
    """In the next power of two of slots, 512 at least."""
    size = max(512, 1 << max(0, len(shingles) - 1).bit_length())
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """Shingles in which two texts differ, at least, by their long parities."""
    x, y = (np.frombuffer(v, np.uint8) for v in (x, y))
    while len(x) != len(y):  # fold the longer
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_be(n: np.ndarray, m: np.ndarray, i: int, j: np.ndarray, least: float) -> np.ndarray:
    """Of the rows j, those that sizes and parities leave for row i."""
    apart = np.bitwise_count((m[j] ^ m[i]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return j[apart <= (1 - least) / (1 + least) * (n[i].astype(np.int64) + n[j]) + 1e-9]


def common_slots(texts: DataFrame, words: int, seed: int) -> np.ndarray:
    """Counts of a bounded sample's shingles by slot, where they are not rare."""
    n = texts.count()
    sample = texts if n <= SAMPLE else texts.where(F.col("row") < int((SAMPLE / n - 0.5) * 2**64))
    schema = pa.schema([("slot", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            for _, _, part in some(b.column(0)):
                at, n = np.unique(np.concatenate([shingle_set(t, words, seed) % np.uint64(SLOTS) for t in part]), return_counts=True)
                yield batch(schema, slot=at.astype(np.int64), n=n)

    found = sample.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(f"n >= {OFTEN}").toArrow()
    out = np.zeros(SLOTS, np.uint16)
    out[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), 65535)
    return out


def buckets(batches, columns: tuple[str, ...]):
    """Arrays of the columns (row and n first) for each token that more than one row has, by size and row; a row comes once."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    token, *rest = (rows.column(c).to_numpy() for c in ("token", *columns))
    order = np.lexsort((rest[0], rest[1], token))
    token, rest = token[order], [r[order] for r in rest]
    once = np.append(True, (token[1:] != token[:-1]) | (rest[0][1:] != rest[0][:-1]))
    if not once.all():  # copies of one text
        token, rest = token[once], [r[once] for r in rest]
    edge = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
    many = np.flatnonzero(np.diff(edge) > 1)
    for a, z in zip(edge[many].tolist(), edge[many + 1].tolist()):
        yield token[a:z], *(r[a:z] for r in rest)


def gathered(pieces, schema: pa.Schema):
    """Tuples of arrays as batches of a fair size."""
    held, n = [], 0
    for p in pieces:
        held.append(p)
        n += len(p[0])
        if n >= PAIRS:
            yield batch(schema, **dict(zip(schema.names, map(np.concatenate, zip(*held)))))
            held, n = [], 0
    if held:
        yield batch(schema, **dict(zip(schema.names, map(np.concatenate, zip(*held)))))


def new_texts(batches, most: int = 1 << 20):
    """(row, text) of batches (row, text), leaving out rows that the task met lately: most copies of a text."""
    seen: set[int] = set()
    for b in batches:
        for i, j, part in some(b.column(1)):
            for row, text in zip(b.column(0).slice(i, j - i).to_pylist(), part):
                if row not in seen:
                    if len(seen) >= most:
                        seen.clear()
                    seen.add(row)
                    yield row, text


def sketched(texts: DataFrame, words: int, seed: int) -> DataFrame:
    """(row, n, fp, odd, parities), a row for each text."""
    schema = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("odd", pa.binary()), *((m, pa.int64()) for m in PARITIES)])

    def run(batches):
        rows = []

        def made():
            row, n, fp, odd, short = zip(*rows)
            short = np.array(short).view(np.int64)
            return batch(schema, row=row, n=n, fp=np.array(fp, np.uint64).view(np.int64), odd=odd, **{m: short[:, k] for k, m in enumerate(PARITIES)})

        for row, text in new_texts(batches):
            h = np.array(simhash.hashes(text, words, seed), np.uint64)
            s = np.unique(h)
            rows.append((row, len(s), simhash.long_majority(h) if len(h) else 0, long_parities(s), parities(s)))
            if len(rows) == 4096:
                yield made()
                rows = []
        if rows:
            yield made()

    fields = "row long, n int, fp long, odd binary, " + ", ".join(f"{m} long" for m in PARITIES)
    return texts.select("row", "text").mapInArrow(run, fields).dropDuplicates(["row"])


def shared_tokens(texts: DataFrame, words: int, least: float, seed: int) -> DataFrame:
    """(token, row, n): prefix shingles that more than one text has."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(common_slots(texts, words, seed))
    schema = pa.schema([("token", pa.int64()), ("row", pa.int64()), ("n", pa.int32())])

    def emit(batches):
        def pieces():
            for row, t in new_texts(batches):
                s = shingle_set(t, words, seed)
                p = prefix(s, sent.value, least)
                yield p.view(np.int64), np.full(len(p), row), np.full(len(p), len(s), np.int32)

        yield from gathered(pieces(), schema)

    def keep(batches):
        yield from gathered(buckets(batches, ("row", "n")), schema)

    fields = "token long, row long, n int"
    return texts.select("row", "text").mapInArrow(emit, fields).repartition(partitions(spark), "token").mapInArrow(keep, fields)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def led(shared: DataFrame, near: DataFrame, least: float) -> DataFrame:
    """(a, b): each text b with the one that leads most of its tokens (the smallest text that its size fits), and with its SimHash component's least text (near)."""

    def run(batches):
        def pieces():
            for _, row, n in buckets(batches, ("row", "n")):
                a = 0
                while a < len(row) - 1:
                    z = a + int(fits(n[a], n[a:], least).sum())
                    yield np.full(z - a - 1, row[a]), row[a + 1 : z]
                    a = max(z, a + 1)

        yield from gathered(pieces(), PAIR)

    pairs = shared.repartition(partitions(shared.sparkSession), "token").mapInArrow(run, "a long, b long")
    pairs = pairs.groupBy("a", "b").count().groupBy("b").agg(F.max(F.struct("count", "a")).alias("top"))
    return pairs.select("top.a", "b").union(near)


def parted(shared: DataFrame, sketches: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of tokens whose texts are in different components, with root and parities."""
    rows = shared.join(roots.select(F.col("node").alias("row"), "root"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    mixed = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    return rows.join(mixed, "token", "left_semi").join(sketches.select("row", *PARITIES), "row").select("token", "row", "n", "root", *PARITIES)


def probed(shared: DataFrame, sketches: DataFrame, roots: DataFrame, least: float, round_: int) -> DataFrame:
    """(a, b): neighbours of different components in a random order of every PROBED-th token's texts."""
    rows = parted(shared.where(F.pmod(F.xxhash64("token"), F.lit(PROBED)) == round_), sketches, roots)

    def run(batches):
        def pieces():
            for token, row, n, root, *m in buckets(batches, ("row", "n", "root", *PARITIES)):
                order = np.argsort((row ^ token[0]) * np.int64(0x2545F4914F6CDD1D), kind="stable")
                row, n, root, m = row[order], n[order].astype(np.int64), root[order], np.stack(m, 1)[order]
                apart = np.bitwise_count((m[1:] ^ m[:-1]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                keep = (root[1:] != root[:-1]) & (apart <= (1 - least) / (1 + least) * (n[1:] + n[:-1]) + 1e-9) & fits(np.minimum(n[1:], n[:-1]), np.maximum(n[1:], n[:-1]), least)
                yield np.minimum(row[1:], row[:-1])[keep], np.maximum(row[1:], row[:-1])[keep]

        yield from gathered(pieces(), PAIR)

    return rows.repartition(partitions(shared.sparkSession), "token").mapInArrow(run, "a long, b long")


def apart(shared: DataFrame, sketches: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of a token's texts that are in different components and fit in size and parities."""

    def run(batches):
        def pieces():
            for _, row, n, root, *m in buckets(batches, ("row", "n", "root", *PARITIES)):
                m = np.stack(m, 1)
                for i in range(len(row) - 1):
                    z = i + int(fits(n[i], n[i:], least).sum())
                    other = np.arange(i + 1, z)
                    other = row[may_be(n, m, i, other[root[i + 1 : z] != root[i]], least)]
                    if len(other):
                        yield np.minimum(row[i], other), np.maximum(row[i], other)

        yield from gathered(pieces(), PAIR)

    return parted(shared, sketches, roots).repartition(partitions(shared.sparkSession), "token").mapInArrow(run, "a long, b long")


def plausible(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The distinct pairs that long parities leave."""

    def run(batches):
        for b in batches:
            cols = [c.to_pylist() for c in b.columns[2:]]
            good = [least_apart(x, y) <= (1 - least) / (1 + least) * (n + m) + 1e-9 for n, x, m, y in zip(*cols)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=PAIR).filter(pa.array(good, pa.bool_()))

    pairs = pairs.distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("row").alias(side), F.col("n").alias(f"{side}_n"), F.col("odd").alias(f"{side}_odd")), side)
    return pairs.select("a", "b", "a_n", "a_odd", "b_n", "b_odd").mapInArrow(run, "a long, b long")


def bitmap(rows: DataFrame) -> np.ndarray:
    """A bit for each of BITS slots that the rows fall into: at most BITS / 64 numbers come to the driver."""
    at = F.pmod("row", F.lit(BITS))
    found = rows.select((at / 64).cast("long").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(row, {BITS}) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out


def asked(batches, bits: np.ndarray):
    """The rows of batches (row, ..) that the bitmap lets through."""
    for b in batches:
        at = np.mod(b.column(0).to_numpy(), BITS)
        yield b.filter(pa.array(bits[at // 64] >> (at % 64) & 1 == 1))


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float, seed: int) -> DataFrame:
    """The pairs whose sets (SET_BYTES of each hash) are so similar; sets are made only for texts of pairs."""
    spark = texts.sparkSession
    pairs = cut(spark, pairs, "pairs")
    sent = spark.sparkContext.broadcast(bitmap(pairs.select(F.col("a").alias("row")).union(pairs.select("b"))))
    schema = pa.schema([("row", pa.int64()), ("sh", pa.binary())])

    def make(batches):
        for row, t in new_texts(asked(batches, sent.value)):
            s = np.unique(shingle_set(t, words, seed) >> np.uint64(64 - 8 * SET_BYTES))
            yield batch(schema, row=[row], sh=[s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()])

    sets = cut(spark, texts.select("row", "text").mapInArrow(make, "row long, sh binary").dropDuplicates(["row"]), "sets")

    def unpack(raw: bytes) -> np.ndarray:
        wide = np.zeros((len(raw) // SET_BYTES, 8), np.uint8)
        wide[:, :SET_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, SET_BYTES)
        return wide.view("<u8").ravel()

    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = unpack(x), unpack(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=PAIR).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(sets.select(F.col("row").alias("a"), F.col("sh").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("sh").alias("y")), "b")
    found = cut(spark, joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "alike")
    forget(pairs, sets)
    return found


def similar_texts(texts: DataFrame, words: int = 5, least: float = 0.8, seed: int = 42) -> DataFrame:
    """(node, root) for every row of texts (row, text) that is similar to another: root names the component."""
    spark: SparkSession = texts.sparkSession
    sketches = cut(spark, sketched(texts, words, seed), "sketches")
    shared = cut(spark, shared_tokens(texts, words, least, seed), "shared")
    near = simhash.grouped(sketches.select(F.col("row").alias("doc_id"), "fp")).where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    alike = verified(plausible(led(shared, near, least), sketches, least), texts, words, least, seed)
    roots = simhash.components(spark, alike)
    for k in range(PROBES):
        more = verified(plausible(probed(shared, sketches, roots, least, k), sketches, least), texts, words, least, seed)
        if more.isEmpty():
            continue
        alike = alike.union(more)
        roots = simhash.components(spark, alike)
    rest = verified(plausible(apart(shared, sketches, roots, least), sketches, least), texts, words, least, seed)
    if rest.isEmpty():
        forget(shared)
        return roots
    out = simhash.components(spark, alike.union(rest))
    forget(shared)
    return out
