"""Byte-level BPE: ranked merges folded over the bytes of distinct words by Spark's higher-order functions, and decoding.

Texts are split into words (each match of the tokenizer's pattern) a chunk of documents at a time: a chunk keeps its
documents as numbers of its own distinct words.  The distinct words of all chunks (of CHUNKS_TOGETHER tasks at a time, so
that no list of a word's chunks grows without end) are encoded once: `aggregate` folds a word's pieces, in each step joining
the leftmost pair of the least rank, with ranks looked up in a literal map (an array of small maps by crc32, because a map
is searched from end to end).  Decoding looks ids up in a literal array and concatenates the binary pieces.  Encoded words go
back to their chunks, which lie in a table bucketed by chunk and are not moved.

Defined results: a null text is an empty one (no ids); a null id is kept; repeated rows are each encoded; an empty table
gives an empty result; other columns are ignored.  A word's fold takes time with the square of its own length, which is
that of the longest run without a change between letters, digits, marks and blanks.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treegrammar.llm.common import Buckets, batch, give_back, partitions, read

CHUNK, SLICE = 32 << 20, 2 << 20  # bytes of text of a chunk and of what is split at once
TOGETHER = 1 << 19  # words that are put together, and rows that are packed, at once
CHUNKS_TOGETHER = 4096  # tasks whose chunks share a word's encoding
BUCKETS = 1 << 14  # maps that share the ranks
NONE = (1 << 31) - 1  # rank of what is no token
EDGE = "."  # stands before and after a word's pieces and is part of no token

# ------------------------------------------------- words

BLANK, LETTER, DIGIT, MARK = range(4)


@cache
def kinds() -> np.ndarray:
    """The kind of every code point."""
    import regex

    points = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "" for c in range(0x110000))
    out = np.full(0x110000, MARK, np.uint8)
    for kind, pattern in ((BLANK, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for m in regex.finditer(pattern, points):
            out[m.start() : m.end()] = kind
    return out


def words(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in the UTF-8 bytes of texts that stand one after another, and the words before each text and in all.

    Words are the matches of public_tokenizers.PATTERN: runs of letters, digits or marks with a space before them, short
    English endings after an apostrophe, and runs of blanks less the last blank before something else.
    """
    point = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
    n = len(point)
    size = (1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)).astype(np.int64)
    at = np.append(0, np.cumsum(size))  # bytes before each point
    begins = np.searchsorted(at, starts)
    kind = kinds()[point]
    first = np.zeros(n + 1, bool)
    first[begins] = True
    new = first[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(new)
    end = np.append(run[1:], n)[: len(run)]
    more = ~first[end] & (end < n)  # another run of the same text follows
    word = np.append(new, True)
    blank = (kind[run] == BLANK) & more
    last, then = end[blank] - 1, end[blank]
    word[last] = True  # the last blank before something else stands alone,
    word[then[point[last] == 0x20]] = False  # or, if a space, begins the next word
    short = np.flatnonzero((kind[run] == MARK) & more & (end - run == 1) & (point[run] == ord("'")) & word[run])
    short = short[kind[run[short + 1]] == LETTER] if len(short) else short
    if len(short):
        a, z = run[short + 1], end[short + 1]
        one, two = point[a], np.where(z - a > 1, point[np.minimum(a + 1, n - 1)], 0)
        took = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
        for x, y in ("re", "ve", "ll"):
            took[(one == ord(x)) & (two == ord(y))] = 2
        word[a[took > 0]] = False
        rest = a + took
        word[rest[(took > 0) & (rest < z)]] = True
    where = np.flatnonzero(word[:n])
    return at[where], np.append(np.searchsorted(where, begins), len(where))


def parts(text: bytes):
    """A text in slices that end before a space after an ASCII letter or digit, where words always part."""
    start = 0
    while len(text) - start > SLICE:
        k = text.rfind(b" ", start + 1, start + SLICE)
        while k > 0 and not text[k - 1 : k].isalnum():
            k = text.rfind(b" ", start + 1, k)
        if k < 0:
            k = text.find(b" ", start + SLICE)
            while k > 0 and not text[k - 1 : k].isalnum():
                k = text.find(b" ", k + 1)
            if k < 0:
                break
        yield text[start:k]
        start = k
    yield text[start:]


def slices(texts: pa.Array):
    """(documents that begin here, bytes, where each of the slice's texts begins); a text longer than a slice comes in several, the later ones with no documents."""
    binary = pc.fill_null(texts.cast(pa.binary()), b"")
    size = np.append(0, np.cumsum(pc.binary_length(binary).to_numpy(zero_copy_only=False).astype(np.int64)))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, size[i] + SLICE, side="right")) - 1)
        if size[j] - size[i] > SLICE:
            for k, part in enumerate(parts(binary[i].as_py())):
                yield int(k == 0), part, np.zeros(1, np.int64)
        else:
            yield j - i, b"".join(binary.slice(i, j - i).to_pylist()), size[i:j] - size[i]
        i = j


CHUNKS = "chunk long, ids array<long>, counts array<long>, codes binary, words array<binary>"


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk, ids, counts, codes, words): documents as numbers in the list of their chunk's distinct words. counts: each document's words; codes: their numbers, squeezed."""
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary()), ("words", pa.list_(pa.binary()))])

    def run(batches):
        name, held, size = TaskContext.get().partitionId() << 32, [], 0
        ids, counts = [], []

        def close():
            nonlocal name
            if held:
                coded = pa.chunked_array(held).unify_dictionaries()
                codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
                order = np.argsort(-np.bincount(codes), kind="stable")  # frequent words get small numbers
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                codes, known = place[codes], coded.chunk(0).dictionary.take(pa.array(order))
            else:
                codes, known = np.zeros(0, np.int64), pa.array([], pa.binary())
            out = batch(schema, chunk=[name], ids=[ids], counts=[counts], codes=[squeezed(codes)], words=pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known))
            name += 1
            return out

        for b in batches:
            ahead = iter(b.column(0).to_pylist())
            for n, data, starts in slices(b.column(1)):
                at, before = words(data, starts)
                own = np.diff(before)
                if n:
                    if size + len(data) > CHUNK and ids:
                        yield close()
                        held, size, ids, counts = [], 0, [], []
                    ids.extend(next(ahead) for _ in range(n))
                    counts.extend(own.tolist())
                else:
                    counts[-1] += len(at)
                size += len(data)
                if len(at):
                    offsets = pa.py_buffer(np.append(at, len(data)).astype(np.int32).tobytes())
                    held.append(pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(data)]).dictionary_encode())
        if ids:
            yield close()
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, CHUNKS)


# ------------------------------------------------- ranked merges and decoding


def rank_file(path: str) -> dict[bytes, int]:
    """A vocabulary of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Ranks:
    """Columns over a vocabulary's literal rank map; bytes are written as upper-case hexadecimal digits."""

    def __init__(self, ranks: dict[bytes, int]):
        hexed = {t.hex().upper(): r for t, r in ranks.items()}
        if missing := [b for b in range(256) if f"{b:02X}" not in hexed]:
            raise ValueError(f"no rank for bytes {missing}")
        maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        for h, r in hexed.items():
            maps[zlib.crc32(h.encode()) % BUCKETS][h] = r
        by_id = [""] * (max(ranks.values()) + 1)
        for h, r in hexed.items():
            by_id[r] = h
        self.maps = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")
        self.pieces = F.split(F.lit(" ".join(by_id)), " ")

    def encode(self, word: Column) -> Column:
        """array<int>: ids of one word (a match of the pattern)."""
        # the literals are bound to names, so that a plan holds each of them once
        ids = let(self.maps, lambda maps: let(self.pieces, lambda pieces: let(F.hex(word), lambda hexed: encoded(maps, pieces, hexed))))
        return F.when(F.octet_length(word) == 0, F.array().cast("array<int>")).otherwise(ids)

    def decode(self, ids: Column) -> Column:
        """The bytes of ids; null if one of them is no id of the vocabulary."""

        def joined(hexed: Column) -> Column:
            return F.when(F.forall(hexed, lambda h: h.isNotNull()), F.unhex(F.array_join(hexed, "")))

        return let(F.transform(ids, lambda i: F.nullif(F.get(self.pieces, i), F.lit(""))), joined)


def encoded(maps: Column, pieces: Column, hexed: Column) -> Column:
    """Ids of a word's bytes: the word's own id if it is a token, else those of its pieces when no pair of neighbours is a token any more."""

    def rank(h: Column) -> Column:
        """A token's id, which is its rank; NONE if it is no token."""
        bucket = F.pmod(F.crc32(h.cast("binary")), F.lit(BUCKETS)).cast("int")
        return F.coalesce(F.get(maps, bucket)[h], F.lit(NONE))

    def merge(state: Column, _: Column) -> Column:
        """One step of the fold. state: pieces p with an edge at both ends, and the rank r of each pair of neighbours."""

        def joined(s: Column, k: Column) -> Column:  # k: the leftmost pair of the least rank
            p, r = s["p"], s["r"]
            piece = F.get(pieces, F.get(r, k - 1))
            near = F.array(rank(F.concat(F.get(p, k - 2), piece)), rank(F.concat(piece, F.get(p, k + 1))))
            after = F.struct(F.concat(F.slice(p, 1, k - 1), F.array(piece), F.slice(p, k + 2, F.size(p))).alias("p"), F.concat(F.slice(r, 1, k - 2), near, F.slice(r, k + 2, F.size(r))).alias("r"))
            return F.when(F.get(r, k - 1) == NONE, s).otherwise(after)

        # a fold of one element binds k without copying the state
        return F.aggregate(F.array(F.array_position(state["r"], F.array_min(state["r"])).cast("int")), state, joined)

    def fold(h: Column) -> Column:
        steps, edge = F.sequence(F.lit(1), (F.length(h) / 2).cast("int")), F.array(F.lit(EDGE))
        each = F.concat(edge, F.transform(steps, lambda i: F.substring(h, 2 * i - 1, F.lit(2))), edge)
        begin = let(each, lambda p: F.struct(p.alias("p"), F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: rank(F.concat(F.get(p, i - 1), F.get(p, i)))).alias("r")))
        return F.aggregate(steps, begin, merge, lambda s: F.transform(F.slice(s["p"], 2, F.size(s["p"]) - 2), rank))

    return let(rank(hexed), lambda own: F.when(own < NONE, F.array(own)).otherwise(fold(hexed)))


# ------------------------------------------------- documents



def squeezed(values: np.ndarray) -> bytes:
    """Numbers below 2^32: all lowest bytes first, then the next ones ..., zstd. Their count is not kept."""
    return pa.Codec("zstd", compression_level=6).compress(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * n), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


PACKED = "chunk long, words long, tokens long, bytes long, at binary, counts binary, ids binary, sizes binary, decoded binary"


def packed(found: DataFrame) -> DataFrame:
    """Rows (chunk, n, ids, decoded) of a task as a few rows a chunk, so that they take little room where they are dealt out again: steps of n, numbers of ids, ids, sizes and bytes decoded."""
    kinds_of = {"long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds_of[f.split()[1]]) for f in PACKED.split(", ")])

    def pack(rows: pa.Table):
        rows = rows.combine_chunks().sort_by([("chunk", "ascending"), ("n", "ascending")]).combine_chunks()
        chunk, n = rows.column("chunk").to_numpy(), rows.column("n").to_numpy()
        ids, decoded = rows.column("ids").chunk(0), rows.column("decoded").chunk(0)
        edges = np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1, append=chunk[-1] + 1))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own, raw = ids.slice(i, j - i), decoded.slice(i, j - i)
            flat, data = own.flatten().to_numpy(), b"".join(raw.to_pylist())
            counts, sizes = own.value_lengths().to_numpy(), pc.binary_length(raw).to_numpy()
            yield batch(schema, chunk=[chunk[i]], words=[j - i], tokens=[len(flat)], bytes=[len(data)], at=[squeezed(np.diff(n[i:j], prepend=0))], counts=[squeezed(counts)], ids=[squeezed(flat)], sizes=[squeezed(sizes)], decoded=[pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= TOGETHER:
                yield from pack(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from pack(pa.Table.from_batches(held))
        give_back()

    return found.select("chunk", "n", "ids", "decoded").mapInArrow(run, PACKED)


def unpacked(known: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Ids and decoded bytes of a chunk's words by their number."""
    if not known.num_rows:
        return pa.array([], pa.list_(pa.int32())), pa.array([], pa.binary())
    at, ids, decoded = [], [], []
    for r in known.to_pylist():
        n = r["words"]
        at.append(np.cumsum(unsqueezed(r["at"], n)))
        ends = np.append(0, np.cumsum(unsqueezed(r["counts"], n))).astype(np.int32)
        ids.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(unsqueezed(r["ids"], r["tokens"]).astype(np.int32))))
        ends = np.append(0, np.cumsum(unsqueezed(r["sizes"], n))).astype("<i4")
        decoded.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.Codec("zstd").decompress(r["decoded"], r["bytes"])]))
    order = pa.array(np.argsort(np.concatenate(at), kind="stable"))
    return pa.concat_arrays(ids).take(order), pa.concat_arrays(decoded).take(order)


def put_together(known: pa.Table, chunk: pa.Table) -> pa.Table:
    """(doc_id, ids, decoded) of one chunk's documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
    ids_of, decoded_of = unpacked(known)
    row = chunk.to_batches()[0]
    doc_ids, counts = row.column("ids")[0].values, row.column("counts")[0].values.to_numpy()
    before = np.append(0, np.cumsum(counts))
    codes = unsqueezed(row.column("codes")[0].as_py(), int(before[-1]))
    out, i = [], 0
    while i < len(doc_ids):
        j = max(i + 1, int(np.searchsorted(before, before[i] + TOGETHER, side="right")) - 1)
        own, ends = pa.array(codes[before[i] : before[j]]), before[i : j + 1] - before[i]
        ids, decoded = ids_of.take(own), decoded_of.take(own)
        tokens = np.append(0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))[ends]
        size = np.append(0, np.cumsum(pc.binary_length(decoded).to_numpy(zero_copy_only=False).astype(np.int64)))[ends]
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(size.astype("<i8").tobytes()), decoded.buffers()[2] or pa.py_buffer(b"")])
        out.append(pa.RecordBatch.from_arrays([doc_ids.slice(i, j - i), pa.ListArray.from_arrays(pa.array(tokens.astype(np.int32)), ids.flatten()), whole.cast(pa.binary())], schema=schema))
        i = j
    give_back()
    return pa.Table.from_batches(out, schema)


def encoded_texts(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every document; decoded: the bytes of its ids."""
    spark, table = docs.sparkSession, Ranks(ranks)
    tables = Buckets(spark, "chunk")
    chunks = tables.put(chunked(docs, id_col, text_col), dealt=False)
    uses = chunks.select(F.shiftright("chunk", 32).alias("task"), "chunk", F.posexplode("words").alias("n", "word"))
    uses = uses.withColumn("tasks", F.floor(F.col("task") / CHUNKS_TOGETHER)).repartition(partitions(spark), "word", "tasks")  # a number of its own: few bytes, much work
    known = uses.groupBy("word", "tasks").agg(F.collect_list(F.struct("chunk", "n")).alias("at")).select("at", table.encode(F.col("word")).alias("ids"))
    found = packed(known.select("ids", table.decode(F.col("ids")).alias("decoded"), F.explode("at").alias("at")).select("at.*", "ids", "decoded"))
    rows = chunks.select(F.col("chunk").alias("of"), "ids", "counts", "codes")
    out = found.groupBy("chunk").cogroup(rows.groupBy("of")).applyInArrow(put_together, "doc_id long, ids array<int>, decoded binary")
    return out


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of ids, sha256 of the ids in decimal and of the bytes they decode to."""
    import public_tokenizers

    out = encoded_texts(read(spark, sf_dir, "documents"), rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
