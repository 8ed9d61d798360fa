import base64
import hashlib
import random

import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers as P
from treegrammar.llm import bytepairs

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = "a Bé'stvrelmd 12½!?.' \t\n\r  　中文字日本語한국어🙂́​ʼß٣Ⅷ_-\x1c\x85"


def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(texts):
    raw = [t.encode() for t in texts]
    starts = [sum(map(len, raw[:i])) for i in range(len(raw))]
    data = b"".join(raw)
    at, before = bytepairs.words(data, bytepairs.np.array(starts, dtype="int64"))
    found = [data[i:j].decode() for i, j in zip(at, [*at[1:], len(data)])]
    return [found[i:j] for i, j in zip(before, before[1:])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(ODD, max_size=40)), min_size=1, max_size=6))
def test_words_are_the_matches_of_the_pattern(texts):
    assert split(texts) == [regex.findall(P.PATTERN, t) for t in texts]


def test_every_code_point_is_split_as_the_library_does():
    enc = plain()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4096):
        text = "".join(f"a{c}a1{c}1!{c}!" for c in points[i : i + 4096])
        (found,) = split([text])
        ids = [t for w in found for t in enc._core_bpe.encode_single_piece(w.encode())]
        assert ids == enc.encode_ordinary(text), hex(ord(points[i]))


def test_parts_join_and_part_between_words(monkeypatch):
    monkeypatch.setattr(bytepairs, "SLICE", 50)
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choices(ODD + "   abc", k=rnd.randrange(400)))
        pieces = list(bytepairs.parts(text.encode()))
        assert b"".join(pieces) == text.encode()
        assert [w for p in pieces for w in split([p.decode()])[0]] == regex.findall(P.PATTERN, text)


def texts():
    rnd = random.Random(5)
    out = [None, "", " ", "\n", "a", "hello world's  end \n\n x", "I'll've 'tis it''s 's", "   lead", "trail   ", "日本語のテキスト", "naïve café ½ ٣", "\x00\x01", "zq" * 400, "a" * 700, "  " * 300, "word " * 3000]
    out += ["".join(rnd.choices(ODD, k=rnd.randrange(60))) for _ in range(150)]
    return out + ["same text twice"] * 3


def test_documents_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(bytepairs, "SLICE", 900)
    monkeypatch.setattr(bytepairs, "CHUNK", 3000)
    monkeypatch.setattr(bytepairs, "TOGETHER", 100)
    enc, rows = plain(), [(i, t, "x", "y") for i, t in enumerate(texts())] + [(None, "no id", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, chunk string").repartition(3)
    got = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in bytepairs.encoded_texts(docs, bytepairs.rank_file(PATH)).collect()}
    assert len(got) == len(rows)
    assert got == {i: (enc.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows}


def test_empty_table_and_query(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bytepairs.encoded_texts(docs, bytepairs.rank_file(PATH)).collect() == []
    spark.createDataFrame([(1, "two words"), (2, None), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, bytepairs.op11_bpe_codec(spark, str(tmp_path)).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = plain().encode_ordinary("two words")
    assert got == [(1, len(ids), sha(" ".join(map(str, ids)).encode()), sha(b"two words")), *[(2, 0, sha(b""), sha(b""))] * 2]


def test_what_is_no_id_decodes_to_null_and_bytes_must_have_ranks(spark):
    ranks = bytepairs.Ranks({**{bytes([b]): b for b in range(256)}, b"ab": 256, b"bc": 257, b"abc": 300})
    df = spark.createDataFrame([(b"abc", [97, 256]), (b"xbc", [299]), (b"", []), (b"\xffab", [400]), (b"abcabb", [300, 98])], "w binary, i array<int>")
    got = df.select(ranks.encode(F.col("w")), ranks.decode(F.col("i"))).collect()
    assert [(list(a), b if b is None else bytes(b)) for a, b in got] == [([300], b"aab"), ([120, 257], None), ([], b""), ([255, 256], None), ([300, 256, 98], b"abcb")]
    with pytest.raises(ValueError):
        bytepairs.Ranks({b"a": 0})
