"""Streams of document parts: cut anywhere, restarted, out of order."""

import random
import time

import pytest

from treegrammar.operators.pool import Pool
from treegrammar.operators.validate import validate_one
from treegrammar.plans.model import compile_text
from treegrammar.streaming.tokens import DONE, PartRun, part_rows, validate_parts
from treegrammar.functions.sql import parts

SCHEMA = "element a { attribute k { xsd:int }?, (element b { list { xsd:int+ } } & element c { text }?), element d { (element d { empty } | text)?, mixed { element e { empty }* } }* }"
DOCS = [
    '<a k="1"><b>1 2</b><c>t</c></a>', '<a k="z"><b>1</b></a>', "<a><c/><b>1</b><d>x<e/>y<e/></d><d><d/></d></a>", "<a>", "<a><b>1</b></a><!-- --><x/>", "<a><b>x</b></a>", "<a><b>1</b>t</a>", "<a/>", "<z/>", "<p:a/>",
    "<a><b>1<!-- -->2</b></a>", "<a><b>1</b><d>&u;</d></a>", '<a w=""><b>1</b></a>', "<a><b> 1\n</b> <d> </d> </a>", "", "<a><d/><b>1</b></a>", "<a><b>1</b><q:c/></a>",
]


def tokens(xml):
    found = [(p[0], *p[2:6]) for p in parts(xml)]
    return [*found, (len(found), DONE, None, None, None)]


@pytest.mark.parametrize("xml", DOCS)
def test_cut_at_any_part_and_carried_to_another_pool(xml):
    schema = compile_text(SCHEMA)
    want, all_ = validate_one(xml, schema)[:2], tokens(xml)
    rnd = random.Random(len(xml))
    for cut in range(len(all_) + 1):
        first, pool = PartRun(Pool(schema)), Pool(schema)
        for junk in ("c", "b"):  # other numbers for the same patterns
            pool.open(pool.close(pool.open(pool.start, "", "a")), "", junk)
        done = first.take(all_[:cut])
        second = first if done else PartRun(pool, first.saved())
        rest = all_[cut:] + all_[:cut]  # again, which changes nothing
        rnd.shuffle(rest)
        done = done or second.take(rest)
        assert done and (second.kind is None, second.kind) == want, cut


def test_pools_exchange_patterns():
    schema = compile_text(SCHEMA)
    a, b = Pool(schema), Pool(schema)
    p = a.close(a.att(a.open(a.start, "", "a"), "", "k", "1"))
    for name in ("c", "b", "d", "d"):
        b.open(b.start, "", name)
        q = b.imported(a.exported(p))
        assert a.imported(b.exported(q)) == p and a.nullable[p] == b.nullable[q]
        child = a.close(a.open(p, "", name))
        p = a.end(a.leaf(child, "1"))
        assert p != a.NONE


def test_stream_with_a_restart_gives_the_rows_of_the_table(spark, tmp_path):
    schema = compile_text(SCHEMA)
    rows = part_rows(spark.createDataFrame(list(enumerate(DOCS)), "doc_id int, xml string"))
    want = {r.doc_id: (r.valid, r.error_kind) for r in validate_parts(rows, schema).collect()}
    assert want == {i: validate_one(x, schema)[:2] for i, x in enumerate(DOCS)}
    all_ = sorted(map(tuple, rows.collect()), key=lambda r: (r[1], r[0]))  # documents arrive side by side
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(3):
        spark.createDataFrame(all_[k::3] if k == 2 else [r for i, r in enumerate(all_) if i % 3 == k], rows.schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = validate_parts(stream, schema, "doc_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(once=True).start()
        assert q.awaitTermination(100)
    got = [(r.doc_id, (r.valid, r.error_kind)) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(DOCS) and dict(got) == want


def test_a_document_that_stops_is_given_up(spark, tmp_path):
    schema = compile_text(SCHEMA)
    rows = part_rows(spark.createDataFrame([(1, DOCS[0]), (2, DOCS[0])], "doc_id int, xml string"))
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def more(df):
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        q = validate_parts(stream, schema, "doc_id", patience_ms=1000).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(once=True).start()
        assert q.awaitTermination(100)

    more(rows.where("doc_id = 2 or n < 3"))
    time.sleep(2)
    more(rows.where("doc_id = 2 and n = 0").selectExpr("3 as doc_id", *[f"`{c}`" for c in rows.columns[1:]]))
    got = {r.doc_id: r.error_kind for r in spark.read.parquet(out).collect()}
    assert got == {1: "abandoned", 2: None}


def test_qnames_are_refused(spark):
    with pytest.raises(ValueError):
        validate_parts(spark.createDataFrame([], "doc_id int, n int, kind string, ns string, local string, value string"), compile_text('element a { xsd:QName "b" }'))
