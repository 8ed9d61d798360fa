"""Tables, streams, suites and the command line."""

import subprocess
import sys

import pytest

from treegrammar.operators.relational import children_valid, content_regex
from treegrammar.functions.sql import EXTERNAL, parts
from treegrammar.operators.validate import all_errors, patterns, validate, validate_one
from treegrammar.plans.model import compile_text
from treegrammar.sources.documents import read_xml
from treegrammar.sources.suite import cases, run_suite, run_suites
from treegrammar.streaming.tokens import part_rows, validate_parts
from treegrammar.streaming.validate import read_documents, validate_stream

SCHEMA = 'element a { element b { xsd:int { maxInclusive = "5" } }* }'


def test_odd_rows_and_extra_columns(spark):
    rows = [(1, "<a/>", "v", True), (2, None, "v", True), (3, "", "v", True), (4, "<a><b>6</b></a>", "v", True), (None, "<a><b>5</b></a>", "v", True), (1, "<a/>", "v", True), (5, "<a>" + "<b>1</b>" * 50_000 + "</a>", "v", True)]
    df = spark.createDataFrame(rows, "doc_id long, xml string, message string, valid boolean")
    got = validate(df, compile_text(SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.valid, r.error_kind or "") for r in got) == [(0, True, ""), (1, True, ""), (1, True, ""), (2, False, "null"), (3, False, "xml"), (4, False, "text"), (5, True, "")]
    assert validate(df.limit(0), compile_text(SCHEMA)).collect() == []


def test_relational_agrees_with_the_automaton(spark):
    schema = compile_text("element a { element x { empty }?, (element y { empty } | element z { empty }, element y { empty })+ }")
    import itertools

    rows, docs = [], {}
    for n in range(4):
        for word in itertools.product("xyzq", repeat=n):
            key = "".join(word) or "-"
            docs[key] = "<a>" + "".join(f"<{c}/>" for c in word) + "</a>"
            rows += [(key, i, c) for i, c in enumerate(word)]
    got = {r.k: r.valid for r in children_valid(spark.createDataFrame(rows, "k string, i int, name string"), schema, "k", ["i"], "name").collect()}
    assert got == {k: validate_one(d, schema)[0] for k, d in docs.items() if k != "-"}
    with pytest.raises(ValueError):
        content_regex(compile_text("element a { element b { empty } & element c { empty } }"))


def test_files_and_streams_agree(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(6):
        (tmp_path / f"in/{i}.xml").write_text(f"<a>\n<b>{i + 2}</b></a>")
    schema = compile_text(SCHEMA)
    batch = {r.doc_id: (r.valid, r.line) for r in validate(read_xml(spark, f"{tmp_path}/in"), schema).collect()}
    q = validate_stream(read_documents(spark, f"{tmp_path}/in", 2), schema, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    stream = {r.doc_id: (r.valid, r.line) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert stream == batch and sum(v for v, _ in batch.values()) == 4


def test_suite(spark):
    text = """<testSuite><testSuite><testCase><section>4</section><correct><element xmlns="http://relaxng.org/ns/structure/1.0" name="a"><empty/></element></correct>
      <valid><a/></valid><invalid><b/></invalid><invalid><a x=""/></invalid></testCase></testSuite>
      <testCase><incorrect><element xmlns="http://relaxng.org/ns/structure/1.0"/></incorrect></testCase>
      <testCase><dir name="d"><resource name="x.rng"><element xmlns="http://relaxng.org/ns/structure/1.0" name="a"><empty/></element></resource></dir>
      <correct><externalRef xmlns="http://relaxng.org/ns/structure/1.0" href="d/x.rng"/></correct><valid><a/></valid><valid><b/></valid></testCase></testSuite>"""
    assert len(cases(text)) == 3
    assert [r.outcome for r in run_suite(spark, text).collect()] == ["passed", "passed", "valid 1"]


def test_suites_of_a_table(spark):
    good = '<testSuite><testCase><correct><element xmlns="http://relaxng.org/ns/structure/1.0" name="a"><empty/></element></correct><valid><a/></valid><valid><b/></valid></testCase></testSuite>'
    df = spark.createDataFrame([(1, good, "c"), (2, "<testSuite>", "c"), (3, None, "c"), (4, "<testSuite/>", "c")], "suite_id int, text string, outcome string")
    assert [(r.suite_id, r.nth, r.kind, r.outcome and r.outcome[:7]) for r in run_suites(df).orderBy("suite_id").collect()] == [(1, 0, "correct", "valid 1"), (2, 0, None, "suite: ")]
    assert run_suites(df.limit(0)).collect() == []


def test_external_entities_are_errors(spark):
    schema = compile_text("element a { text }")
    doc = '<!DOCTYPE a [<!ENTITY e SYSTEM "x.txt"><!ENTITY f "y">]><a>&f;</a>'
    assert validate_one(doc, schema)[:2] == (False, "external_entity") and validate_one(doc.replace('SYSTEM "x.txt"', '"z"'), schema)[0]
    assert [p[2] for p in parts(doc)] == ["error"] and parts(doc)[0][5] == EXTERNAL
    rows = spark.createDataFrame([(1, doc)], "doc_id long, xml string")
    assert [r.error_kind for r in all_errors(rows, schema).collect()] == ["external_entity"]
    assert [r.error_kind for r in validate_parts(part_rows(rows, "doc_id"), schema, "doc_id").collect()] == ["external_entity"]


def test_patterns_table(spark):
    rows = patterns(spark, compile_text(SCHEMA), ["<a><b>1</b></a>"]).collect()
    assert {"after", "element", "data", "more"} <= {r.op for r in rows} and len({r.pid for r in rows}) == len(rows)


def test_command_line(tmp_path):
    (tmp_path / "s.rnc").write_text(SCHEMA)
    (tmp_path / "bad.rnc").write_text("element a {")
    (tmp_path / "1.xml").write_text("<a/>")
    (tmp_path / "2.xml").write_text("<a>\n<c/></a>")
    run = lambda *a: subprocess.run([sys.executable, "-m", "treegrammar", "validate", *(str(tmp_path / x) for x in a)], capture_output=True, text=True)
    assert run("s.rnc", "1.xml").returncode == 0 and run("bad.rnc", "1.xml").returncode == 1
    out = run("s.rnc", "1.xml", "2.xml")
    assert out.returncode == 2 and "2.xml:2:2: element-start not expected here; expected Element b" in out.stderr


def test_functions_of_spark_sql(spark):
    from treegrammar.functions.sql import parts, register_tokens, register_valid

    register_valid(spark, compile_text("element a { attribute k { xsd:int }, text }"))
    register_tokens(spark)
    docs = ["<a k='1'>x<![CDATA[<]]><!-- c -->y</a>", "<a/>", None, "<p:a xmlns='urn:d' q='1'>t</p:a", ""]
    spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, xml string").createOrReplaceTempView("some_docs")
    assert [r.v for r in spark.sql("SELECT rng_valid(xml) AS v FROM some_docs ORDER BY i").collect()] == [True, False, False, False, False]
    got = {}
    for r in spark.sql("SELECT i, t.* FROM some_docs, LATERAL rng_tokens(xml) AS t ORDER BY i, n").collect():
        got.setdefault(r.i, []).append(tuple(r)[1:])
    assert got == {i: parts(d) for i, d in enumerate(docs) if parts(d)}
    assert [p[2:6] for p in got[0]] == [("element", "", "a", None), ("attribute", "", "k", "1"), ("text", None, None, "x<y"), ("end", "", "a", None)]
    assert got[3][0][2:5] == ("element", None, "a") and got[3][-1][2] == "error" and [p[2] for p in got[4]] == ["error"]
