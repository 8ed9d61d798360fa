"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are 64 majority bits over XXH64 of word shingles.  Distinct fingerprints are dealt by exact segments (two
codes at most ``radius`` bits apart agree on some choice of segments), so that each segment value is one independent
index.  Inside an index the codes stand in Gray rank; runs of neighbours form nodes that hold the bits all their members
share (mask and pattern), less what their parent holds already.  A query walks down with the accumulated difference and
drops a whole node as soon as that exceeds the radius.  Links leave an index as a spanning forest; connected components
of the rest are found by alternating large and small stars over written tables.

Defined results: a null text is an empty text and has fingerprint zero; texts shorter than a shingle are one shingle;
repeated rows share a fingerprint and a component; rows with a null id keep their place in a component but never name it
(a component without any id has a null component_id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treegrammar.llm.common import batch, cut, forget, partitions, read

SLICE = 1 << 16  # shingles whose bits are unpacked at once
FANOUT = 8
GROUPS = 1 << 18  # rows of segment values that a worker takes at once
FRONTIER = 1 << 20  # pairs of a query and a node looked at at once


def hashes(text: str | None, words: int, seed: int) -> list[int]:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return []
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    h = xxhash.xxh64_intdigest
    return [h(s, seed) for s in shingles]


def majority(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of values that begins at starts: bit i is set if it is in over half of the run."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    n = np.diff(np.append(starts, len(values)))
    return np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def long_majority(values: np.ndarray) -> int:
    """The same for one text of any length, in slices."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(values), SLICE):
        ones += np.unpackbits(values[i : i + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprint_all(texts: list[str | None], words: int, seed: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    values: list[int] = []
    starts: list[int] = []
    rows: list[int] = []

    def flush() -> None:
        if rows:
            out[rows] = majority(np.array(values, np.uint64), np.array(starts))
            values.clear(), starts.clear(), rows.clear()

    for i, text in enumerate(texts):
        h = hashes(text, words, seed)
        if len(h) > SLICE:
            out[i] = long_majority(np.array(h, np.uint64))
        elif h:
            if len(values) + len(h) > SLICE:
                flush()
            starts.append(len(values))
            rows.append(i)
            values += h
    flush()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp holds the unsigned fingerprint's bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fp = fingerprint_all(b.column(1).to_pylist(), words, seed)
            yield batch(schema, doc_id=b.column(0), fp=fp.view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- the index


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order: the inverse of x ^ (x >> 1)."""
    r = codes.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        r = r ^ (r >> np.uint64(s))
    return r


def segments(radius: int, blocks: int) -> list[int]:
    """Masks of all choices of blocks - radius segments out of blocks: two codes within the radius agree on one of them."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(one, blocks - radius)]


class GrayIndex:
    """Index over codes that are grouped by key (one tree a key), sorted by key and Gray rank."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), keys))
        self.keys, self.codes = keys[order], codes[order].astype(np.uint64)
        self.n = len(codes)
        starts = np.flatnonzero(np.append(True, self.keys[1:] != self.keys[:-1])) if self.n else np.zeros(0, np.int64)
        #: levels[0] are the codes; each level has first: first item of a node; begin: first child; mask; pattern.
        full = np.full(self.n, ~np.uint64(0))
        self.levels = [{"first": np.arange(self.n), "mask": full, "pattern": self.codes}]
        root_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, self.n)))
        group = root_of
        while self.n and len(self.levels[-1]["first"]) > len(starts):
            below = self.levels[-1]
            at = np.arange(len(group)) - np.searchsorted(group, group)  # place of a node among its tree's nodes
            begin = np.flatnonzero(at % FANOUT == 0)
            first = below["first"][begin]
            ands, ors = np.bitwise_and.reduceat(self.codes, first), np.bitwise_or.reduceat(self.codes, first)
            mask = ~(ands ^ ors)
            self.levels.append({"first": first, "begin": begin, "mask": mask, "pattern": ands & mask})
            group = group[begin]
        for up, low in zip(self.levels[1:], self.levels):  # children keep what the parent doesn't hold
            up["end"] = np.append(up["begin"][1:], len(low["first"]))
            parent = np.repeat(np.arange(len(up["begin"])), up["end"] - up["begin"])
            low["own"] = low["mask"] & ~up["mask"][parent]
        if self.n:
            self.levels[-1]["own"] = self.levels[-1]["mask"]
        for level in self.levels:
            level["last"] = np.append(level["first"][1:], self.n) - 1
        self.root_of = root_of

    def pairs(self, radius: int, label: np.ndarray | None = None, queries: np.ndarray | None = None):
        """Yields arrays (i, j), i < j, of items of a key within the radius. label: an array the caller may change between yields; nodes whose items all carry the query's label are passed over."""
        top = len(self.levels) - 1
        q = np.arange(self.n) if queries is None else queries
        step = max(1, FRONTIER // (FANOUT * FANOUT))
        for s in range(0, len(q), step):
            i = q[s : s + step]
            bounds = [(np.minimum.reduceat(label, x["first"]), np.maximum.reduceat(label, x["first"])) for x in self.levels] if label is not None and self.n else None
            node = self.root_of[i] if top else i
            stack = [(top, i, node, np.zeros(len(i), np.uint8))]
            while stack:
                k, i, node, acc = stack.pop()
                level = self.levels[k]
                acc = acc + np.bitwise_count((self.codes[i] ^ level["pattern"][node]) & level["own"][node])
                keep = (acc <= radius) & (level["last"][node] > i)
                if k == 0:
                    keep &= node > i
                if bounds is not None:
                    keep &= ~((bounds[k][0][node] == label[i]) & (bounds[k][1][node] == label[i]))
                i, node, acc = i[keep], node[keep], acc[keep]
                if not len(i):
                    continue
                if k == 0:
                    yield i, node
                    continue
                n = level["end"][node] - level["begin"][node]
                i, acc = np.repeat(i, n), np.repeat(acc, n)
                child = np.repeat(level["begin"][node] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                for c in range(0, len(i), FRONTIER):
                    stack.append((k - 1, i[c : c + FRONTIER], child[c : c + FRONTIER], acc[c : c + FRONTIER]))


def forest(keys: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of each key: (code, code of its component's first item)."""
    index = GrayIndex(keys, codes)
    label = np.arange(index.n)

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    def settle() -> None:
        while (nxt := label[label]).tobytes() != label.tobytes():
            label[:] = nxt

    def link(i, j) -> None:
        a, b = label[i], label[j]
        new = np.flatnonzero(a != b)
        if len(new):
            for x, y in np.unique(np.stack([a[new], b[new]], 1), axis=0).tolist():
                x, y = root(x), root(y)
                if x != y:
                    label[max(x, y)] = min(x, y)
            settle()

    if index.n > 1:
        near = (index.keys[1:] == index.keys[:-1]) & (np.bitwise_count(index.codes[1:] ^ index.codes[:-1]) <= radius)
        # runs of close neighbours first: a dense group becomes one label at once
        start = np.flatnonzero(np.append(True, ~near))
        label[:] = np.repeat(start, np.diff(np.append(start, index.n)))
        for i, j in index.pairs(radius, label):
            link(i, j)
    moved = np.flatnonzero(label != np.arange(index.n))
    return index.codes[moved], index.codes[label[moved]]


def links(codes: DataFrame, radius: int = 3, blocks: int | None = None, expected: int | None = None) -> DataFrame:
    """(a, b): links that connect what the pairs of distinct codes (column fp) within the radius connect.

    blocks: segments that a code is cut into (over radius); by default the fewest that leave under 256 random codes a
    segment value: 4 up to 16 million codes, then 5 (26 bits, 10 choices), then 6.
    """
    spark = codes.sparkSession
    if blocks is None:
        n = codes.count() if expected is None else expected
        blocks = next((b for b in range(radius + 1, radius + 3) if n <= 256 << (64 * (b - radius) // b)), radius + 3)
    masks = [m - (1 << 64) if m >> 63 else m for m in segments(radius, blocks)]
    dealt = codes.select(F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("k", "v"), "fp")
    dealt = dealt.repartition(partitions(spark), "k", "v").sortWithinPartitions("k", "v")  # a worker holds whole segment values, GROUPS rows of them at a time
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def whole(batches):
        """Arrays k, v, fp that end where a segment value ends."""
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append([b.column(c).to_numpy() for c in ("k", "v", "fp")])
                n += b.num_rows
            if n >= GROUPS:
                k, v, fp = map(np.concatenate, zip(*held))
                cut_at = int(np.flatnonzero((k != k[-1]) | (v != v[-1]))[-1] + 1) if (k[0], v[0]) != (k[-1], v[-1]) else 0
                if cut_at:
                    yield k[:cut_at], v[:cut_at], fp[:cut_at]
                held, n = [[k[cut_at:], v[cut_at:], fp[cut_at:]]], len(k) - cut_at
        if held:
            yield tuple(map(np.concatenate, zip(*held)))

    def run(batches):
        for k, v, fp in whole(batches):
            key = np.cumsum(np.append(0, (k[1:] != k[:-1]) | (v[1:] != v[:-1])))
            many = np.bincount(key)[key] > 1
            a, b = forest(key[many], fp[many].view(np.uint64), radius)
            yield batch(schema, a=a.view(np.int64), b=b.view(np.int64))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node it reaches.

    Large and small stars take turns over written tables until nothing changes; a node's links are never gathered into
    one row, only their minimum, and joins on busy nodes are left to adaptive skew splitting.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
        joined = both.join(least, both["a"] == least["u"])
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = cut(spark, edges.where("a <> b"), "links")
    before = None
    for _ in range(max_rounds):
        nxt = cut(spark, star(star(now, True), False), "stars")
        forget(now)
        now, after = nxt, state(nxt)
        if after == before or after[0] == 0:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def grouped(rows: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of a written table (doc_id, fp): component_id is the least id that fingerprints at most radius bits apart reach."""
    spark = rows.sparkSession
    codes = cut(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    reach = components(spark, links(codes.select("fp"), radius, blocks))
    rooted = codes.join(reach, codes["fp"] == reach["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    named = rooted.join(names, rooted["root"] == names["r"]).select(F.col("fp").alias("code"), "component_id")
    return rows.join(named, rows["fp"] == named["code"]).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    return grouped(cut(docs.sparkSession, fingerprints(docs, id_col, text_col, words, seed), "fingerprints"), radius, blocks)


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
