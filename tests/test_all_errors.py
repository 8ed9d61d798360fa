"""Validation that goes on after an error."""

import random

from treegrammar.operators.pool import Pool
from treegrammar.operators.validate import all_errors, errors_of, uses_qnames, validate_text
from treegrammar.plans.model import compile_text

SCHEMA = "element a { attribute k { xsd:int }, attribute m { text }, element b { 'x' }, element c { attribute q { text }, empty }*, element d { element e { xsd:int }+ }? }"


def kinds(schema, xml):
    return [(e[1], e[7]) for e in errors_of(Pool(compile_text(schema)), xml)]


def test_each_fault_is_reported_once():
    assert kinds(SCHEMA, '<a k="1" m=""><b>x</b></a>') == []
    assert kinds(SCHEMA, '<a k="z" q="1"><b>y</b><f><g/>text</f><c/><d/></a>') == [("attribute", "a"), ("attribute", "a"), ("element-open-end", "a"), ("text", "b"), ("element-start", "f"), ("element-open-end", "c"), ("element-close", "d")]
    assert kinds(SCHEMA, '<a k="1" m="">t<b>x</b>u<d><e>1</e><e>w</e></d></a>') == [("text", "a"), ("text", "a"), ("text", "e")]
    assert kinds(SCHEMA, "<z/>") == [("element-start", "z")]
    assert kinds(SCHEMA, '<a k="1" m=""><p:b/><b p:x="">x</b></a>') == [("undefined_namespace_prefix", "p:b"), ("undefined_namespace_prefix", "b")]
    assert [k for k, _ in kinds(SCHEMA, '<a k="z" m=""><b>x</b>')] == ["attribute", "xml"]
    assert [e[1] for e in errors_of(Pool(compile_text(SCHEMA)), None)] == ["null"]


def test_the_first_error_is_that_of_validation_and_none_means_valid():
    rnd, pool = random.Random(3), Pool(compile_text(SCHEMA))

    def tree(depth):
        name = rnd.choice("aabbccddeef")
        inner = "".join(tree(depth - 1) for _ in range(rnd.randrange(4))) if depth else rnd.choice(["x", "1", "", " "])
        return f"<{name}{rnd.choice(['', ' q=\"\"', ' k=\"1\"', ' k=\"1\" m=\"\"'])}>{inner}</{name}>"

    seen = set()
    good = '<a k="1" m=""><b>x</b><c q=""/><d><e>1</e></d></a>'
    for i in range(3000):
        xml = tree(3) if i % 2 else good.replace(*rnd.choice([("<b>x", "<b>y"), (' q=""', ""), ("<e>1</e>", "<e/>"), (' m=""', ' m="" w=""'), ("<c", "<b>x</b><c"), ("1</e>", "1</e>t"), ("zz", "")]))
        found, one = errors_of(pool, xml), validate_text(pool, xml)
        assert bool(found) != one[0]
        if found:
            assert tuple(found[0][1:]) == one[1:], xml
            seen.add(found[0][1])
    assert seen == {"element-start", "attribute", "element-open-end", "text", "element-close"}


def test_rows(spark):
    rows = [(1, '<a k="z" m=""><b>y</b></a>'), (2, '<a k="1" m=""><b>x</b></a>'), (None, "<a"), (3, None)]
    got = all_errors(spark.createDataFrame(rows, "id long, xml string"), compile_text(SCHEMA), "id").collect()
    assert sorted((r.id or 0, r.n, r.error_kind, r.line) for r in got if r.error_kind != "null") == [(0, 0, "xml", 1), (1, 0, "attribute", 1), (1, 1, "text", 1)]
    assert [r.id for r in got if r.error_kind == "null"] == [3]
    assert all_errors(spark.createDataFrame([], "id long, xml string"), compile_text(SCHEMA), "id").collect() == []


def test_an_element_named_qname_needs_no_prefixes():
    assert not uses_qnames(Pool(compile_text("element QName { empty }")))
    assert uses_qnames(Pool(compile_text('namespace p = "urn:p" element a { xsd:QName "p:b" }')))
