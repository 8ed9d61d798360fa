import zlib
from functools import cache

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from treegrammar.llm import tokens

SCHEMA = "doc_id long, text string, path string, n long"
TEXTS = ["Hello  world\nfoo\tbar", "", None, "é́ é ñ don't  it's '\n's", "x" * 5000, "a b c\x1cd <|endoftext|> y", "日本語 text", "hello world", "tail " * 3000]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=70))
@settings(max_examples=200, deadline=None)
def test_codes_round_trip(values):
    control, data = tokens.encode(np.array(values, np.uint32))
    assert len(control) == (len(values) + 3) // 4
    assert tokens.decode(control, data, len(values)).tolist() == values


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_pieces_are_the_whole_texts_ids(text):
    path = tokens.vocabulary("word_bpe_49k.json")
    got = np.frombuffer(tokens.pieces(path, False).ids([text])[0], "<u2").tolist()
    assert got == tokenizer(path).encode(text, add_special_tokens=False).ids


@cache
def tokenizer(path):
    return Tokenizer.from_file(path)


def test_files_hold_every_document(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 50)
    rows = [(7 * i % 11, t, "p", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "p", 2), (3, "again", "p", 3), (3, "again", "p", 3)]
    t = tokenizer(tokens.vocabulary("word_bpe_49k.json"))
    ids = sorted(((r[0] is not None, r[0] or 0, np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u2").tobytes()) for r in rows))
    want, at = [], 0
    for named, d, raw in ids:
        x = np.frombuffer(raw, "<u2")
        want.append((d if named else None, at, len(x), zlib.crc32(x.astype("<u4").tobytes())))
        at += len(x)
    got = tokens.token_output(spark.createDataFrame(rows, SCHEMA), folder=f"file://{tmp_path}/files").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokens.token_output(spark.createDataFrame([], SCHEMA)).collect() == []


def test_flat_files_are_counted(spark):
    rows = [(i, t, "p", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "p", 2)]
    path = tokens.vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    names = tokens.write_flat(spark.createDataFrame(rows, SCHEMA), path, 49407, tokens.scratch(spark, "t"))
    files = names.selectExpr("file", "path", "n").distinct()
    scan = tokens.separator_scan(files, 49407, 2, 7)
    got = scan.join(names.select("file", "nth", "doc_id"), ["file", "nth"]).select("doc_id", "n_tokens").collect()
    want = [(r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_op5_on_empty_and_repeated_rows(spark, tmp_path):
    import pyarrow as pa

    for n, rows in enumerate(([], [(1, "a b"), (1, "a b"), (None, None), (2, "")])):
        folder = tmp_path / str(n)
        folder.mkdir()
        d, t = zip(*rows) if rows else ([], [])
        pq.write_table(pa.table({"doc_id": pa.array(d, pa.int64()), "text": pa.array(t, pa.string()), "n_tokens": pa.array([0] * len(rows), pa.int64())}), folder / "documents.parquet")
        got = tokens.op5_token_counts(spark, str(folder)).collect()
        assert sorted(map(tuple, got), key=str) == sorted([(d, len((t or "").split())) for d, t in rows], key=str)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_documents_cross_blocks_and_files(spark, tmp_path, block):
    rnd = np.random.default_rng(3)
    parts = [rnd.integers(0, 5, n).astype("<u2") for n in (20, 1, 0, 33)] + [np.array([1, 2], "<u2")]
    for i, p in enumerate(parts):
        p.tofile(tmp_path / f"{i}.ids")
    files = spark.createDataFrame([(i, f"file://{tmp_path}/{i}.ids", len(p)) for i, p in enumerate(parts)], "file int, path string, n long")
    stream = np.concatenate(parts).tolist()
    want, start = [], 0
    for i, x in enumerate(stream):
        if x == 0:
            want.append((len(want), start, i - start, True))
            start = i + 1
    want.append((len(want), start, len(stream) - start, False))
    got = tokens.separator_scan(files, 0, 2, block).select("doc", "start", "n_tokens", "ended").collect()
    assert sorted(map(tuple, got)) == want


def test_every_letter_before_marks():
    """Letters whose composed lower case is more than letters must not be taken apart from what follows them."""
    path = tokens.vocabulary("word_bpe_49k.json")
    own, t = tokens.Pieces(path, False), tokenizer(path)
    letters = [c for c in map(chr, range(0x80, 0x30000)) if c.isalpha() and not ("㐀" < c < "鿿" or "가" < c < "힣" or c > "\U00020000")]
    pieces = [f"{a}{c}{m}" for c in letters for a, m in (("", "."), ("b", ",.."))]
    for i in range(0, len(pieces), 2000):
        part = pieces[i : i + 2000]
        got = [np.frombuffer(x, "<u2").tolist() for x in own.ids(part)]
        assert got == [e.ids for e in t.encode_batch(part, add_special_tokens=False)]


@given(st.text(st.sampled_from("aBİक़ড়ਲ਼́é.,'s <|>\n\t　123"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_odd_texts(text):
    path = tokens.vocabulary("word_bpe_49k.json")
    assert np.frombuffer(tokens.pieces(path, False).ids([text])[0], "<u2").tolist() == tokenizer(path).encode(text, add_special_tokens=False).ids


def test_memo_forgets_what_is_old():
    m = tokens.Memo(4)
    for i in range(20):
        for k in m.missing({"often", i}):
            m.young[k] = str(k)
        assert m.young["often"] == "often" and len(m.young) + len(m.old) <= 8
    assert m.missing({0}) == [0]


def test_slices_of_texts_are_encoded_as_the_library_does(monkeypatch):
    """Words and marks go through the library once for each distinct word, whatever marks, case and texts they stand in."""
    import pyarrow as pa

    path = tokens.vocabulary("word_bpe_49k.json")
    rnd = np.random.default_rng(8)
    parts = ["the", "The", "straße", "Élan", "élan", "quickly", "don't", "", "a.b", "x7", "...", "日本", "<|endoftext|>"]
    marks = ["", ".", ",", "..", ".,", ".\n", ",\n\n"]
    texts = [" ".join(rnd.choice(parts) + rnd.choice(marks) for _ in range(n)) for n in rnd.integers(0, 60, 80)] + [None, "", " ", "no"]
    own, t = tokens.Pieces(path, False), tokenizer(path)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for _ in range(2):
        ids, ends = own.encoded(pa.array(["left out", *texts, "left out"])[1:-1])
        assert [x.tolist() for x in np.split(ids, ends)] == [*want, []]
        monkeypatch.setattr(own, "many", lambda words, tokenizer: words and pytest.fail("words were encoded again"))
    none, at = own.encoded(pa.array([], pa.string()))
    assert len(none) == len(at) == 0
