"""Namespaces by joins against the reader's scopes."""

import random

from pyspark.sql import functions as F

from treegrammar.functions.sql import parts
from treegrammar.operators import scopes


def document(rnd, depth=0):
    name = rnd.choice(["", "p:", "q:", "xml:"]) + rnd.choice("abc")
    declared = "".join(f' xmlns{k}="{rnd.choice(["urn:1", "urn:2", ""])}"' for k in {rnd.choice(["", ":p", ":q"]) for _ in range(rnd.randrange(3))} if True)
    declared = declared.replace(':p=""', ':p="urn:3"').replace(':q=""', ':q="urn:3"')
    attributes = rnd.choice(["", ' k="1"', ' p:k="1" k="2"', ' xml:lang="en"'])
    inner = "".join(document(rnd, depth + 1) if rnd.random() < 0.7 else "t" for _ in range(rnd.randrange(4))) if depth < 4 else ""
    return f"<{name}{declared}{attributes}>{inner}</{name}>"


def test_every_name_has_the_namespace_that_the_reader_gives(spark, monkeypatch):
    monkeypatch.setattr(scopes, "BIN", 5)
    rnd = random.Random(4)
    docs = [(i, document(rnd), "x", 1) for i in range(60)] + [(100, None, "x", 1), (101, "", "x", 1), (102, "<a xmlns='urn:1'><b/>", "x", 1), (103, "<p:a xmlns:p='urn:1'><p:b xmlns:p='urn:2'/><p:c/></p:a><!-- -->", "x", 1), (None, "<a/>", "x", 1)]
    raw = scopes.raw_tokens(spark.createDataFrame(docs, "doc_id long, xml string, ns string, n int")).cache()
    got: dict = {}
    for r in sorted(scopes.resolved(raw).collect(), key=lambda r: r.n):
        got.setdefault(r.doc_id, []).append((r.kind, r.ns, r.local, r.value))
    want = {i: [p[2:6] for p in parts(x) if p[2] != "error"] for i, x, *_ in docs}
    assert {i: w for i, w in want.items() if w} == {i: [(k, ns, loc, v) for k, ns, loc, v in g] for i, g in got.items()}
    lost = {(r.doc_id, r.n) for r in scopes.undefined(raw).collect()}
    assert lost == {(r.doc_id, r.n) for r in scopes.resolved(raw).where("kind <> 'text' and ns is null").collect()} and len(lost) > 20


def test_a_part_meets_only_declarations_of_its_bin(spark, monkeypatch):
    monkeypatch.setattr(scopes, "BIN", 64)
    xml = "<r xmlns:p='urn:0'>" + "".join(f"<p:a xmlns:p='urn:{i}'><p:b/></p:a><p:c/>" for i in range(500)) + "</r>"
    raw = scopes.raw_tokens(spark.createDataFrame([(1, xml)], "doc_id long, xml string"))
    rows = scopes.resolved(raw).where("local in ('b', 'c') and kind = 'element'").orderBy("n").collect()
    assert [(r.local, r.ns) for r in rows] == [x for i in range(500) for x in (("b", f"urn:{i}"), ("c", "urn:0"))]
    assert scopes.undefined(raw).isEmpty()
    plan = scopes.resolved(raw)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
