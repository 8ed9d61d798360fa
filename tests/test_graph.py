"""Tables of schemas."""

import pickle

from treegrammar.functions.datatypes import XSD, compile_datatype
from treegrammar.plans import graph
from treegrammar.sources.schemas import Memory


def test_rules_references_and_what_nothing_reaches(spark):
    texts = [
        (1, "start = a  a = element a { b? }  b = c | empty  c = element c { a* }  d = element d { e? }  e = element e { d? }", "x"),
        (2, "element a { text }", "x"),
        (3, "start = zz", "x"),
        (4, None, "x"),
        (5, "start = a a = element a { grammar { start = b b = element b { parent a? } } }", "x"),
    ]
    df = spark.createDataFrame(texts, "schema_id long, text string, rule string")
    rules, edges = graph.rules(df), graph.edges(df)
    assert sorted((r.schema_id, r.name) for r in graph.unused(rules, edges).collect()) == [(1, "d"), (1, "e")]
    assert sorted((r.schema_id, r.name) for r in graph.recursive(rules, edges).collect()) == [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (1, "e"), (5, "a"), (5, "b"), (5, "start")]
    assert sorted((r.schema_id, r.kind) for r in graph.errors(df).collect()) == [(3, "UndefinedReference"), (4, "null")]
    inside = {(r.rule, r.target): r.inside for r in edges.where("schema_id = 1").collect()}
    names = {r.name: r.rule for r in rules.where("schema_id = 1").collect()}
    assert inside[names["a"], names["b"]] is True and inside[names["b"], names["c"]] is False
    assert {r.kind for r in graph.tree_nodes(df).where("schema_id = 2").collect()} >= {"Schema", "Element", "Text"}
    none = df.limit(0)
    assert graph.unused(graph.rules(none), graph.edges(none)).collect() == [] == graph.errors(none).collect()


def test_loaded_files(spark):
    files = {"a.rnc": "include 'b.rnc'", "b.rnc": "start = element b { empty }"}
    df = spark.createDataFrame([(1, "include 'a.rnc'"), (2, "include 'gone.rnc'"), (3, "empty")], "schema_id long, text string")
    assert sorted((r.schema_id, r.path) for r in graph.loaded(df, files).collect()) == [(1, "a.rnc"), (1, "b.rnc")]
    assert [r.kind for r in graph.errors(df, files=files).collect()] == ["Io"]
    assert Memory(files).load("b.rnc").startswith("start")


def test_places_of_errors(spark):
    files = {"a.rnc": "include 'b.rnc'", "b.rnc": "start = x", "c.rnc": "a = text\nstart = a"}
    texts = {
        1: ["  include 'a.rnc'", ("b.rnc", 8), ("a.rnc", 0), ("schema", 2)],
        2: ["include 'c.rnc' a = empty", ("schema", 16), ("c.rnc", 0)],
        3: ["start |= empty start &= text", ("schema", 15), ("schema", 0)],
        4: ["start = a a = b b = a?", ("schema", 8), ("schema", 14)],
        5: ["datatypes q = 'u' datatypes q = 'v' start = empty", ("schema", 18), ("schema", 0)],
        6: ["element a { attribute b { attribute c { text } } }", ("schema", 26), ("schema", 12)],
        7: ["include 'c.rnc' { y = empty }", ("schema", 18), ("c.rnc", 0)],
        8: ["element a { external 'gone.rnc' }", ("gone.rnc", 0), ("schema", 12)],
        9: ["include 'c.rnc'"],
        10: [None, ("", 0)],
    }
    df = spark.createDataFrame([(k, v[0], 0) for k, v in texts.items()], "schema_id long, text string, n int")
    rows = graph.places(df, files=files).orderBy("schema_id", "n").collect()
    assert {k: [(r.file, r.start) for r in rows if r.schema_id == k] for k in texts} == {k: v[1:] for k, v in texts.items()}
    assert graph.places(df.limit(0), files=files).collect() == []
    e = graph.compiled(texts[2][0], files)
    assert e.described({**files, "schema": texts[2][0]}).split("\n")[1:] == ["  here: schema:1:17: include 'c.rnc' a = empty", "  first defined here: c.rnc:1:1: a = text"]
    assert pickle.loads(pickle.dumps(e)).places == e.places


def test_facets(spark):
    texts = [
        (1, "element a { xsd:short { minExclusive = '4' }, attribute b { xsd:double { maxExclusive = '1.5' } }, list { xsd:token { length = '2' pattern = 'x' pattern = 'y' }, string } }"),
        (2, "element a { xsd:positiveInteger | 'x' | (xsd:int - '3') }"),
        (3, "element a { nowhere }"),
        (4, None),
    ]
    rows = graph.facets(spark.createDataFrame(texts, "schema_id long, text string")).collect()
    of = lambda k: sorted((r.nth, r.type, r.facet, r.value) for r in rows if r.schema_id == k and r.facet) + sorted((r.nth, r.type) for r in rows if r.schema_id == k and not r.facet)
    assert of(1) == [
        (0, "short", "max", "32767"), (0, "short", "min", "5"), (0, "short", "minExclusive", "4"), (1, "double", "max", "1.5"), (1, "double", "maxExclusive", "1.5"),
        (2, "token", "length", "2"), (2, "token", "max_length", "2"), (2, "token", "min_length", "2"), (2, "token", "pattern", "x"), (2, "token", "pattern", "y"), (3, "string"),
    ]
    assert of(2) == [(0, "positiveInteger", "min", "1"), (1, "int", "max", str(2**31 - 1)), (1, "int", "min", str(-(2**31)))]
    assert of(3) == of(4) == []
    assert compile_datatype(XSD, "int", [("minExclusive", "1")]).bounded() and not compile_datatype(XSD, "int", []).bounded()
