"""Tokenising tables, frequency-ranked variable-length token files, and separator scans over flat token files.

Both operators tokenise whole texts with a tokenizers vocabulary.  Vocabularies of the kind used here treat every run of
white space as one dropped separator, so a text's ids are the ids of its pieces between blanks, and each worker keeps the
pieces it has met (those not met again for long are forgotten; results do not depend on it).  Texts are cut and put together
again as Arrow arrays: only the distinct pieces of a slice become Python strings.

Defined results: a null text is an empty one (only the end id); null ids sort first; rows with one id stand in the order
of their token ids; an empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import cache
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treegrammar.llm.common import batch, cut, filesystem, forget, give_back, make_dir, partitions, put_file, read, scratch

MEMO, WORDS = 600_000, 800_000  # pieces and words of letters that a worker keeps, about
#: What the tokenizer looks at apart within a piece of ASCII without apostrophes.
PARTS = re.compile(r"[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")
#: Words of letters that no normaliser or Unicode version sees otherwise, once composed and lowered.
STEADY = "^[a-zß-öø-ÿ]+$"
#: A pre-tokenizer that takes whole runs of letters.
RUNS = "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SLICE_BYTES = 8 << 20  # of texts tokenised at once
BLOCK_IDS = 1 << 20  # ids after which the writer closes a block
MAGIC = b"TGVB\x01\x00\x00\x00"
BLOCK_HEAD = "<IQQQ"  # documents, ids, control bytes, data bytes


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """A dict of bounded size in two generations: what is looked up again outlives what is not."""

    def __init__(self, most: int):
        self.half, self.young, self.old = most // 2, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that must be learned; all others are in young afterwards."""
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young
        new, old = keys.difference(self.young), self.old
        again = new.intersection(old)
        self.young.update((k, old[k]) for k in again)
        return list(new.difference(again))


class Pieces:
    """Ids of texts as little-endian bytes, remembered piece by piece."""

    def __init__(self, path: str, special_as_text: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo, self.parts = Memo(MEMO), Memo(WORDS)
        #: Ids that end a word: in a list of words, each word's ids run up to the next of them.
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.direct = self.bare()

    def bare(self):
        """The same merges without what only other texts than words of letters need; the tokenizer itself where it is of another kind."""
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        before = self.tokenizer.pre_tokenizer
        kinds = json.loads(before.__getstate__()).get("pretokenizers", []) if before else []
        if [k["type"] for k in kinds] != ["Split", "ByteLevel"] or RUNS not in kinds[0]["pattern"].get("Regex", "") or kinds[1]["use_regex"] or kinds[1]["add_prefix_space"]:
            return None
        direct = Tokenizer(self.tokenizer.model)
        direct.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return direct

    def one(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.dtype).tobytes()

    def words(self, words: list[str]) -> None:
        """Remembers words of letters, many to a call; singly where the tokenizer sees other words."""
        self.many(words, self.tokenizer)

    def many(self, words: list[str], tokenizer) -> None:
        size, known = self.dtype.itemsize, self.parts.young
        parts = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for part, got in zip(parts, tokenizer.encode_batch_fast(list(map(" ".join, parts)), add_special_tokens=False)):
            ids = np.array(got.ids, self.dtype)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * size
            if len(ends) != len(part):
                known.update((w, self.one(w)) for w in part)
                continue
            raw, ends = ids.tobytes(), ends.tolist()
            known.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))

    def seen_as(self, words: list[str]) -> list[str]:
        """The words as the tokenizer composes and lowers them."""
        if not words or self.tokenizer.normalizer is None:
            return words
        seen = self.tokenizer.normalizer.normalize_str(" ".join(words)).split(" ")
        return seen if len(seen) == len(words) else [self.tokenizer.normalizer.normalize_str(w) for w in words]

    def learn(self, new: list[str]) -> None:
        """Remembers pieces.  Their words of letters (ASCII ones in lower case, as the tokenizer lowers them) are looked up once."""
        cores = [p.rstrip(".,") for p in new]
        letters = list(map(str.isalpha, cores))
        ascii_ = list(map(str.isascii, new))
        other = [k for k, (a, b) in enumerate(zip(ascii_, letters)) if b and not a]
        for k, w in zip(other, self.seen_as([cores[k] for k in other])):
            letters[k] = w.isalpha()
        simple = [k for k, b in enumerate(letters) if b]  # a word of letters and its marks
        names = [new[k] for k in simple]
        words = [cores[k].lower() if ascii_[k] else cores[k] for k in simple]
        marks = [p[len(cores[k]) :] for k, p in zip(simple, names)]
        rest = [p for p, a, b in zip(new, ascii_, letters) if not b]
        split = [p for p in rest if p.isascii() and "'" not in p and "<|" not in p]
        rest = set(rest).difference(split)
        several = [PARTS.findall(p.lower()) for p in split]
        wanted = {*words, *marks, *chain.from_iterable(several)}
        wanted.discard("")
        missing = self.parts.missing(wanted)
        parts = self.parts.young
        parts[""] = b""
        self.words([w for w in missing if w.isalpha()])
        parts.update((w, self.one(w)) for w in missing if not w.isalpha())
        known, look = self.memo.young, parts.__getitem__
        known.update(zip(names, map(add, map(look, words), map(look, marks))))
        known.update(zip(split, [b"".join(map(look, ws)) for ws in several]))
        known.update((p, self.one(p)) for p in rest)

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's end)."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        of = split.flatten().dictionary_encode()
        names = of.dictionary
        # words of letters and the marks after them, as nearly all pieces are
        cores = pc.utf8_rtrim(names, ".,")
        words = pc.ascii_lower(cores)
        steady = pc.match_substring_regex(words, STEADY) if self.direct else pa.array(np.zeros(len(names), bool))
        other = pc.invert(steady)
        found = pa.concat_arrays([self.steady(words.filter(steady), names.filter(steady), cores.filter(steady)), self.others(names.filter(other).to_pylist())])
        place = np.empty(len(names), np.int64)
        place[np.argsort(other.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(names))
        found = found.take(pa.array(place[of.indices.to_numpy()]))
        at = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1) if len(found) else np.zeros(1, np.int64)
        ids = np.frombuffer(found.buffers()[2] or b"", np.uint8)[: at[-1]].view(self.dtype)
        return ids, at[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))] // self.dtype.itemsize

    def steady(self, words: pa.Array, names: pa.Array, cores: pa.Array) -> pa.Array:
        """Ids of pieces that are words and marks: a mark is what is left of a name behind its core."""
        of = words.dictionary_encode()
        distinct = of.dictionary.to_pylist()
        missing = self.parts.missing(set(distinct))
        self.many(missing, self.direct)
        ids = pa.array(list(map(self.parts.young.__getitem__, distinct)), pa.large_binary()).take(of.indices)
        begin, after = (np.frombuffer(names.buffers()[1], np.int32, len(names) + 1)[k : len(names) + k] for k in (0, 1)) if len(names) else (np.zeros(0, int),) * 2
        many = after - begin - pc.binary_length(cores).to_numpy()
        # which mark: none, one of either kind, or one of the few longer runs
        of_mark, marks = np.zeros(len(names), np.int64), ["", ",", "."]
        one = np.flatnonzero(many == 1)
        of_mark[one] = 1 + (np.frombuffer(names.buffers()[2], np.uint8)[after[one] - 1] == ord("."))
        for k in np.flatnonzero(many > 1).tolist():
            of_mark[k] = len(marks)
            marks.append(names[k].as_py()[-int(many[k]) :])
        of_run = {m: self.one(m) for m in set(marks)}
        each = pa.array(list(map(of_run.__getitem__, marks)), pa.large_binary())
        return pc.binary_join_element_wise(ids, each.take(pa.array(of_mark)), pa.scalar(b"", pa.large_binary()))

    def others(self, names: list[str]) -> pa.Array:
        """Ids of any pieces."""
        new = self.memo.missing(set(names))
        if new:
            self.learn(new)
        return pa.array(list(map(self.memo.young.__getitem__, names)), pa.large_binary())

    def ids(self, texts: list[str | None]) -> list[bytes]:
        ids, ends = self.encoded(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, ends)[: len(texts)]]


@cache
def pieces(path: str, special_as_text: bool) -> Pieces:
    """One for each worker process."""
    return Pieces(path, special_as_text)


def ranges(column: pa.Array, most: int):
    """(first row, row after) of slices with about as many bytes each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        end = int(np.searchsorted(size, (size[start - 1] if start else 0) + most, side="right"))
        end = min(len(column), max(end, start) + 1)
        yield start, end
        start = end


def some(column: pa.Array, most: int = 2 << 20):
    """(first row, row after, texts) of slices with about as many bytes each: only one slice at a time becomes Python strings."""
    for start, end in ranges(column, most):
        yield start, end, column.slice(start, end - start).to_pylist()


def tokenised(docs: DataFrame, vocab: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """(doc_id, ids): ids in the vocabulary's width as bytes, the end id last."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        tok = pieces(vocab, special_as_text)
        for b in batches:
            for i, j in ranges(b.column(1), SLICE_BYTES):
                ids, ends = tok.encoded(b.column(1).slice(i, j - i))
                closed = np.insert(ids, ends, end_id)
                at = np.append(0, ends + np.arange(1, j - i + 1)) * tok.dtype.itemsize
                yield batch(schema, doc_id=b.column(0).slice(i, j - i), ids=pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(closed)]))
            give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


# ------------------------------------------------- frequency ranks and byte-aligned codes


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (four two-bit lengths less one each, lowest first) and the values' bytes, little-endian."""
    r = ranks.astype("<u4")
    size = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]]
    four = np.zeros((len(r) + 3) // 4 * 4, np.uint8)
    four[: len(r)] = size
    four = four.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


_CONTROL = np.arange(256)
#: For each control byte: its four lengths, where each value begins, and what all four take.
SIZES = np.stack([(_CONTROL >> 2 * k & 3) + 1 for k in range(4)], 1)
BEGINS = np.cumsum(SIZES, 1) - SIZES
TOTALS = SIZES.sum(1)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values back, by table lookup on whole control bytes."""
    c = np.frombuffer(control, np.uint8)
    total = TOTALS[c]
    at = ((np.cumsum(total) - total)[:, None] + BEGINS[c]).ravel()[:n]
    raw = np.frombuffer(data + b"\0\0\0\0\0\0\0\0", np.uint8)
    if n and (wide := int(SIZES[c].max())) <= 2:
        value = raw[at].astype(np.uint32) | (raw[at + 1].astype(np.uint32) << 8 if wide == 2 else 0)
    else:
        value = raw[at].astype(np.uint32)
        for k in (1, 2, 3):
            value |= raw[at + k].astype(np.uint32) << np.uint32(8 * k)
    return value & MASKS[SIZES[c].ravel()[:n]]


def counts(tokens: DataFrame, width: int) -> DataFrame:
    """(id, n) over all documents: one partial row for each id and task at most."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        seen = np.zeros(1 << 16, np.int64)
        for b in batches:
            at = np.frombuffer(b.column(0).buffers()[1], np.int32)[b.column(0).offset :][: len(b) + 1]
            raw = np.frombuffer(b.column(0).buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
            c = np.bincount(raw.view(f"<u{width}"))
            if len(c) > len(seen):
                seen = np.append(seen, np.zeros(len(c) - len(seen), np.int64))
            seen[: len(c)] += c
        at = np.flatnonzero(seen)
        yield batch(schema, id=at, n=seen[at])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def rank_table(tokens: DataFrame, width: int) -> np.ndarray:
    """Ids by falling frequency, ties to the smaller id; no longer than the vocabulary."""
    rows = counts(tokens, width).toPandas()
    return rows.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)


def write_ranked(tokens: DataFrame, by_rank: np.ndarray, width: int, folder: str, n_files: int) -> list[tuple[str, int]]:
    """Writes files of ascending doc_id under folder; returns (path, ids in it) in that order. The rank table goes to folder/ranks."""
    make_dir(folder)
    put_file(f"{folder}/ranks", [MAGIC, by_rank.astype("<u4").tobytes()])
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n", pa.int64())])

    def blocks(batches, total):
        yield MAGIC
        ids, docs, n = [], [], 0

        def close():
            length = np.array([len(x) // width for x in ids], "<u8")
            control, data = encode(rank_of[np.frombuffer(b"".join(ids), f"<u{width}")])
            head = struct.pack(BLOCK_HEAD, len(ids), int(length.sum()), len(control), len(data))
            total[0] += int(length.sum())
            named = np.array([d is not None for d in docs], np.uint8)
            return b"".join([head, named.tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(), length.tobytes(), control, data])

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs.append(d)
                ids.append(x)
                n += len(x) // width
                if n >= BLOCK_IDS:
                    yield close()
                    ids, docs, n = [], [], 0
        if ids:
            yield close()

    def run(batches):
        part = TaskContext.get().partitionId()
        path, total = f"{folder}/part-{part:06d}.tgvb", [0]
        put_file(path, blocks(batches, total))
        yield batch(schema, part=[part], path=[path], n=[total[0]])

    dealt = tokens.repartitionByRange(n_files, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids")
    return [(r.path, r.n) for r in sorted(dealt.mapInArrow(run, "part int, path string, n long").collect()) if r.n]


def read_file(path: str, by_rank: np.ndarray):
    """Yields for each block of a file: doc ids (None for null), lengths and all ids."""
    where, p = filesystem(path)
    with where.open_input_stream(p) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is not a ranked token file")
        while head := f.read(struct.calcsize(BLOCK_HEAD)):
            docs, n, control, data = struct.unpack(BLOCK_HEAD, head)
            named = np.frombuffer(f.read(docs), np.uint8)
            ids = [i if k else None for i, k in zip(np.frombuffer(f.read(8 * docs), "<i8").tolist(), named)]
            length = np.frombuffer(f.read(8 * docs), "<u8").astype(np.int64)
            yield ids, length, by_rank[decode(f.read(control), f.read(data), n)].astype("<u4")


def read_ranked(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    rows, at = [], 0
    for path, n in files:  # one row for each file
        rows.append((path, at))
        at += n

    def run(batches):
        where, p = filesystem(f"{folder}/ranks")
        with where.open_input_stream(p) as f:
            by_rank = np.frombuffer(f.read()[len(MAGIC) :], "<u4")
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for docs, length, ids in read_file(path, by_rank):
                    ends = np.cumsum(length)
                    begins = ends - length
                    raw = memoryview(ids.tobytes())
                    crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(begins.tolist(), ends.tolist())]
                    yield batch(schema, doc_id=docs, start=begins + start, n_tokens=length, ids_crc32=crc)
                    start += len(ids)

    listed = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocab: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Tokenises docs, writes ranked token files under folder and returns what they hold, read back."""
    spark = docs.sparkSession
    vocab = vocab or vocabulary("word_bpe_49k.json")
    width = Pieces(vocab, False).dtype.itemsize
    path = scratch(spark, "token-ids")
    tokenised(docs, vocab, end_id, id_col, text_col).write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema("doc_id long, ids binary").parquet(path)
    folder = folder or scratch(spark, "token-files")
    files = write_ranked(tokens, rank_table(tokens, width), width, folder, partitions(spark))
    forget(path)
    return read_ranked(spark, folder, files)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(read(spark, sf_dir, "documents"))


# ------------------------------------------------- flat token files


def write_flat(docs: DataFrame, vocab: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One flat file of ids a task, each document's end id last. Returns the written table (file, nth, doc_id, path, n_tokens in the file); the files themselves hold ids only."""
    spark = docs.sparkSession
    width = Pieces(vocab, True).dtype.itemsize
    make_dir(folder)
    schema = pa.schema([("file", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("path", pa.string()), ("n", pa.int64())])

    def run(batches):
        part, ids, n = TaskContext.get().partitionId(), [], 0
        path = f"{folder}/part-{part:06d}.ids"

        def stream():
            for b in batches:
                ids.extend(b.column(0).to_pylist())
                yield b"".join(b.column(1).to_pylist())

        n = put_file(path, stream()) // width
        for i in range(0, len(ids), 100_000):
            k = len(ids[i : i + 100_000])
            yield batch(schema, file=np.full(k, part, np.int32), nth=np.arange(i, i + k), doc_id=ids[i : i + k], path=[path] * k, n=np.full(k, n))

    return cut(spark, tokenised(docs, vocab, end_id, id_col, text_col, True).mapInArrow(run, "file int, nth long, doc_id long, path string, n long"), "token-names")


def separator_scan(files: DataFrame, end_id: int, width: int, block_tokens: int = 1 << 20) -> DataFrame:
    """(file, doc, nth, start, n_tokens, ended) of every document in flat token files.

    files: (file, path, n), one row a file, in stream order of file; the files are read as one stream, so a document may
    cross blocks and files.  doc counts documents in the stream, nth those that end in the same file.  Each block is
    searched at once; blocks are stitched by a prefix scan of (separators so far, last separator so far), first over the
    blocks of a file and then over the files.  What follows the last separator is a document that has not ended.
    """
    found = "file int, block long, n long, at array<long>"
    schema = pa.schema([("file", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("at", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for file, path, block, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                where, p = filesystem(path)
                with where.open_input_file(p) as f:
                    ids = np.frombuffer(f.read_at(n * width, block * block_tokens * width), f"<u{width}")
                yield batch(schema, file=[file], block=[block], n=[len(ids)], at=[np.flatnonzero(ids == end_id) + block * block_tokens])

    spark = files.sparkSession
    blocks = files.where("n > 0").select("file", "path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block_tokens))).alias("block"), F.least(F.lit(block_tokens).cast("long"), F.col("n") - F.col("block") * block_tokens).alias("n"))
    scanned = blocks.repartition(partitions(spark)).mapInArrow(run, found)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = scanned.withColumns({"seps": F.size("at").cast("long"), "last": F.expr("try_element_at(at, -1)")})
    scanned = cut(spark, scanned.withColumns({"base": F.coalesce(F.sum("seps").over(before), F.lit(0)), "prev": F.max("last").over(before)}), "separators")
    of_file = scanned.groupBy("file").agg(F.sum("n").alias("tokens"), F.sum("seps").alias("ends"), F.max("last").alias("last_in"))
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    of_file = of_file.withColumn("offset", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))
    of_file = of_file.withColumns({"docs_before": F.coalesce(F.sum("ends").over(ahead), F.lit(0)), "carried": F.coalesce(F.max(F.col("last_in") + F.col("offset")).over(ahead), F.lit(-1))})
    joined = scanned.where("seps > 0").join(of_file, "file")
    one = joined.select("file", "base", "docs_before", "offset", F.coalesce(F.col("prev") + F.col("offset"), F.col("carried")).alias("prev"), "at", F.posexplode("at").alias("k", "end"))
    start = F.when(F.col("k") > 0, F.expr("at[k - 1]") + F.col("offset")).otherwise(F.col("prev")) + 1
    ended = one.select("file", (F.col("docs_before") + F.col("base") + F.col("k")).alias("doc"), (F.col("base") + F.col("k")).alias("nth"), start.alias("start"), (F.col("end") + F.col("offset") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = of_file.agg(F.max("file").alias("file"), F.sum("ends").alias("doc"), F.coalesce(F.max(F.col("last_in") + F.col("offset")), F.lit(-1)).alias("last"), F.sum("tokens").alias("all"))
    rest = rest.where("all > last + 1").select("file", "doc", F.lit(None).cast("long").alias("nth"), (F.col("last") + 1).alias("start"), (F.col("all") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(rest)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens): tokens of each document without its end id, counted in the flat files."""
    vocab, end_id = vocabulary("word_bpe_49k.json"), 49407
    names = write_flat(read(spark, sf_dir, "documents"), vocab, end_id, scratch(spark, "flat-tokens"))
    files = names.groupBy("file").agg(F.first("path").alias("path"), F.first("n").alias("n"))
    scan = separator_scan(files, end_id, Pieces(vocab, True).dtype.itemsize)
    named = names.select("file", "nth", "doc_id").hint("merge")  # both sides have a row a document
    return scan.join(named, ["file", "nth"]).select("doc_id", "n_tokens")
