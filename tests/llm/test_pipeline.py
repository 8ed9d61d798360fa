import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from treegrammar.llm import decontaminate, tokens
from treegrammar.llm.common import WORD, cut
from tests.llm.test_decontaminate import least
from tests.llm.test_mixing import filled
from tests.llm.test_similar import survivors
import re

SF = "/root/testdata/sf0.001"
EDITED, TOO_MUCH = {10_010, 10_011}, {10_012}  # documents with a benchmark item within and beyond its budget


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "src1", 0), (10_002, "", "de", None, 0), (10_003, "123 | 456", "fr", "src2", 9), (None, "the of and this with no id at all", None, "src1", 30)], docs.schema)
    item = max((r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()), key=len)
    k = decontaminate.budget(decontaminate.normal(item), decontaminate.BUDGET)
    edited = [(d, "the and of this " * 3 + "".join("q" if i % 5 == 2 and i < 5 * n else c for i, c in enumerate(item)) + " that the of", "en", "src1", 0) for d, n in ((10_010, 1), (10_011, k), (10_012, 3 * k))]
    docs = cut(spark, docs.union(odd).union(spark.createDataFrame(edited, docs.schema)).union(docs.limit(3)), "t")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(cut(spark, stage(spark, out[-1], SF), "t"))
    return out


def test_stages_keep_columns_and_names(stages):
    assert [n for n, _ in cp.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_language_stage_rejects_only_texts_without_letters(stages):
    gone = {r.doc_id for r in stages[0].collect()} - {r.doc_id for r in stages[1].collect()}
    assert gone == {10_001, 10_002, 10_003}
    assert [r.lang for r in stages[1].where("doc_id is null").collect()] == ["en"]


def test_dedup_stage_keeps_one_of_each_group(stages):
    rows = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in stages[1].collect()})
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in stages[2].collect()) == survivors([(-1 if none else d, t) for none, d, t in rows])


def test_decontamination_stage_drops_benchmark_text(stages):
    items = [decontaminate.normal(r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    docs = {r.doc_id: decontaminate.normal(r.text) for r in stages[2].collect()}
    whole = {d for d, text in docs.items() if any(t in text for t in items)}
    dropped = set(docs) - {r.doc_id for r in stages[3].collect()}
    assert whole <= dropped and EDITED <= dropped and not TOO_MUCH & dropped and TOO_MUCH <= set(docs)
    for d in dropped - whole:  # by the plain edit matrix
        assert any(least(t, docs[d]) <= decontaminate.budget(t, decontaminate.BUDGET) for t in items), d


def test_stages_keep_columns_of_any_name(spark):
    names = ["row", "id", "doc", "h", "h2", "node", "root", "size", "taken", "ranges", "rank", "offset", "twin", "hash", "_hash", "_twin", "_row", "_key", "_text", "block", "epoch", "component", "two", "a.b", "TEXT2"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = docs.select("*", *(F.concat(F.lit(n + " "), F.col("doc_id")).alias(n) for n in names))
    for _, stage in cp.STAGES[:-1]:
        out = cut(spark, stage(spark, extra, SF), "t")
        assert out.columns == extra.columns
        assert out.count() and all(r[n] == f"{n} {r.doc_id}" for r in out.collect() for n in names)
    assert cp.write_tokens(spark, extra, SF).count() == 60


def test_mix_stage_meets_its_targets(stages):
    sizes, got = {}, {}
    count = lambda r: len(re.findall(WORD, r.text or ""))
    for into, rows in ((sizes, stages[3]), (got, stages[4])):
        for r in rows.collect():
            into[r.source] = into.get(r.source, 0) + count(r)
    goal = filled(sizes)
    assert all(abs(got[s] - goal[s]) <= 128 for s in sizes)
    words = {(r.doc_id, r.source): set(re.findall(WORD, r.text)) for r in stages[3].collect()}
    assert all(set(re.findall(WORD, r.text)) <= words[r.doc_id, r.source] for r in stages[4].collect())


def test_token_stage_holds_every_row(stages):
    t = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    want = []
    for r in stages[4].collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    rows = sorted(stages[5].collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()


def test_empty_documents(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in cp.STAGES:
        docs = cut(spark, stage(spark, docs, SF), "t")
    assert docs.count() == 0
