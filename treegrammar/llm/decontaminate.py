"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are compared in lower case with single blanks.  An item of n characters may
occur with up to k = floor(n * budget) edits; cut into k + 1 pieces, at least one piece then occurs unchanged.  All pieces
are searched at once (Aho-Corasick); each hit names a window of the document in which the item would lie, overlapping
windows of an item are joined, and Myers' bit-parallel distance gives the least number of edits of the item against any
substring of the window.  An item that no substring matches within k is not reported.  What matches an item of fewer than
min_words words must also begin and end at word bounds: no letter or digit goes on before or after it.

Items are dealt into blocks of about BLOCK_CHARS characters, written to the shared folder: none passes through the driver.  A task
holds the automata of MATCHERS blocks; of more blocks, it takes SLICE bytes of its documents at a time through all of them, so
documents are read once whatever the number of items.

Defined results: null or empty texts and items match nothing, nor do items without an id; repeated documents are reported each, a
repeated item id once for each document, with its least distance; empty tables give an empty result; other columns are ignored by
contaminated() and kept as they are by clean(), whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treegrammar.llm.common import batch, filesystem, numbered, read, scratch

BUDGET = 0.07  # edits a character of the item
MIN_WORDS = 8
BLOCK_CHARS = 4 << 20
SLICE, MATCHERS = 64 << 20, 4  # bytes of documents that a task holds, and blocks of items whose automata it keeps


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of as even a length as can be."""
    n = len(item)
    edge = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edge, edge[1:])]


def bound(text: str, at: int) -> bool:
    """No word goes on across this place."""
    return not (0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum())


class Myers:
    """Least edits of a pattern against the substrings of texts, by columns of the edit matrix held as bits."""

    def __init__(self, pattern: str):
        self.n = len(pattern)
        self.eq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def scores(self, text: str, anchored: bool = False):
        """The least edits of the pattern against what ends after each character of text; anchored: and begins with the text."""
        n, eq = self.n, self.eq
        full, top, first = (1 << n) - 1, 1 << (n - 1), int(anchored)
        pv, mv, score = full, 0, n
        for c in text:
            e = eq.get(c, 0)
            d0 = (((e & pv) + pv) ^ pv) | e | mv
            ph = mv | (full & ~(d0 | pv))
            mh = pv & d0
            score += 1 if ph & top else -1 if mh & top else 0
            yield score
            ph = (ph << 1 | first) & full  # not anchored, a match may begin anywhere: the first row is all zeros
            mh = mh << 1 & full
            pv = mh | (full & ~(d0 | ph))
            mv = ph & d0

    def least(self, text: str) -> tuple[int, int]:
        """(distance, end): the first place where the best match ends."""
        best, end = self.n, 0
        for j, score in enumerate(self.scores(text), 1):
            if score < best:
                best, end = score, j
        return best, end

    def bounded(self, text: str, begin: int, end: int, k: int) -> tuple[int, int]:
        """The same among matches within begin and end that begin and end at word bounds; (k + 1, 0) if none has at most k edits."""
        best = (k + 1, 0)
        for start in range(begin, end):
            if bound(text, start):
                for j, score in enumerate(self.scores(text[start : min(end, start + self.n + k)], True), start + 1):
                    if score <= k and (score, j) < best and bound(text, j):
                        best = score, j
        return best


class Matcher:
    """Searches documents for a block of items: (item_id, text), normalised."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_words: int = MIN_WORDS):
        import ahocorasick

        by_text: dict[str, list[int]] = {}
        for i, text in items:
            by_text.setdefault(text, []).append(i)
        self.short = [text.count(" ") + 1 < min_words for text in by_text]
        self.items = [(ids, text, budget(text, rate)) for text, ids in by_text.items()]
        self.myers: list[Myers | None] = [None] * len(self.items)
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                found.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each item with a hit, where it could lie; windows that overlap are one."""
        raw: dict[int, list[tuple[int, int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            at = last + 1 - size
            for n, offset in places:
                k, length = self.items[n][2], len(self.items[n][1])
                begin = at - offset - k
                raw.setdefault(n, []).append((max(0, begin), min(len(text), at - offset + length + k)))
        out = {}
        for n, spans in raw.items():
            spans.sort()
            joined = [spans[0]]
            for a, b in spans[1:]:
                if a <= joined[-1][1]:
                    joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
                else:
                    joined.append((a, b))
            out[n] = joined
        return out

    def search(self, raw: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of each item within its budget."""
        text = normal(raw)
        out: dict[int, tuple[int, int]] = {}
        for n, spans in self.windows(text).items() if text else ():
            ids, item, k = self.items[n]
            m = self.myers[n] = self.myers[n] or Myers(item)
            if self.short[n]:
                best, end = min(m.bounded(text, a, b, k) for a, b in spans)
            else:
                best, end = min((d, a + e) for a, b in spans for d, e in [m.least(text[a:b])])
            if best <= k:
                out.update((i, min((best, end), out.get(i, (best, end)))) for i in ids)
        return [(i, *out[i]) for i in sorted(out)]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[str]:
    """Folders of the written blocks (i, t) of items: an id is in one block only."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = 1 + chars // BLOCK_CHARS
    path = scratch(spark, "items")
    rows.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(n))).repartition("block").write.partitionBy("block").parquet(path)
    return [f"{path}/block={r.block}" for r in spark.read.schema("i long, t string, block long").parquet(path).select("block").distinct().collect()]  # one row a block


def block_of(folder: str) -> list[tuple[int, str]]:
    where, path = filesystem(folder)
    rows = pq.read_table(path, filesystem=where, columns=["i", "t"], partitioning=None).to_pydict()
    return [(i, t) for i, t in zip(rows["i"], map(normal, rows["t"])) if t]


def searched(batches, column: int | str, blocks: list[str], rate: float, min_words: int):
    """(batch, what each block's matcher finds in its rows): for each batch, a list of finds for each of its rows."""
    made = lru_cache(MATCHERS)(lambda folder: Matcher(block_of(folder), rate, min_words))

    def through(held):
        finds = [[[] for _ in range(b.num_rows)] for b in held]
        for folder in blocks:
            matcher = made(folder)
            for b, found in zip(held, finds):
                for one, text in zip(found, b.column(column)):
                    one += matcher.search(text.as_py())
        yield from zip(held, finds)

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= SLICE or len(blocks) <= MATCHERS:
            yield from through(held)
            held, size = [], 0
    yield from through(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = BUDGET, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, distance, end) of every item that a document holds within its edit budget."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = item_blocks(benchmark, item_col, item_text_col)

    def run(batches):
        for b, finds in searched(batches, 1, blocks, rate, min_words):
            found = [(d, *m) for d, ms in zip(b.column(0).to_pylist(), finds) for m in ms]
            if found:
                d, i, k, e = zip(*found)
                yield batch(schema, doc_id=d, item_id=i, distance=k, end=e)

    return rows.mapInArrow(run, "doc_id long, item_id long, distance int, end long")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = BUDGET, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without those that hold an item."""
    blocks = item_blocks(benchmark, item_col, item_text_col)
    if not blocks:
        return docs
    at = docs.columns.index(text_col)

    def run(batches):
        for b, finds in searched(batches, at, blocks, rate, min_words):
            yield b.filter(pa.array([not f for f in finds], pa.bool_()))

    plain = numbered(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance")
