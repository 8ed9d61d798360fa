"""Rules beyond the syntax, one pair of schemas for each: the first breaks it, the second keeps it."""

import pytest

from treegrammar.errors import SchemaError
from treegrammar.plans.model import compile_text
from treegrammar.plans.restrictions import competing

PAIRS = [
    ("StartContent", "start = element a { empty } | text", "start = element a { empty } | element b { empty }"),
    ("StartContent", "start = element a { empty }, element b { empty }", "start = a | notAllowed a = element a { empty }"),
    ("ListContent", "element a { list { element b { empty } } }", "element a { list { xsd:int, ('x' | xsd:date)* } }"),
    ("ListContent", "element a { list { text } }", "element a { list { empty } }"),
    ("ListContent", "element a { list { xsd:int & xsd:date } }", "element a { list { xsd:int, xsd:date } }"),
    ("ExceptContent", "element a { xsd:int - (list { '1' }) }", "element a { xsd:int - ('1' | '2') }"),
    ("RepeatedAttribute", "element a { (attribute x { text }, element b { empty })+ }", "element a { attribute x { text }, element b { empty }+ }"),
    ("DuplicateAttribute", "element a { attribute x { text }, attribute x { text } }", "element a { attribute x { text } | attribute x { xsd:int } }"),
    ("DuplicateAttribute", "element a { attribute x { text } & attribute * { text }+ }", "element a { attribute x { text } & attribute * - x { text }+ }"),
    ("EndlessAttribute", "element a { attribute * { text } }", "element a { attribute * { text }* }"),
    ("EndlessAttribute", "element a { attribute * { xsd:int }* }", "element a { attribute (x | y) { xsd:int } }"),
    ("DataBesideContent", "element a { xsd:int, element b { empty } }", "element a { xsd:int | element b { empty } }"),
    ("DataBesideContent", "element a { xsd:int, xsd:int }", "element a { xsd:int, attribute x { xsd:int } }"),
    ("DataBesideContent", "element a { xsd:int+ }", "element a { list { xsd:int+ } }"),
    ("InterleavedElements", "element a { element b { text } & element b { text } }", "element a { element b { text }, element b { text } }"),
    ("InterleavedElements", "element a { element b { text } & element * { text } }", "element a { element b { text } & element * - b { text } }"),
    ("InterleavedText", "element a { text & text }", "element a { text & element b { text } }"),
    ("InterleavedText", "element a { mixed { text } }", "element a { mixed { element b { empty } } }"),
]


@pytest.mark.parametrize("kind, bad, good", PAIRS)
def test_one_kind_each(kind, bad, good):
    compile_text(bad)  # accepted where restrictions are not asked for
    with pytest.raises(SchemaError) as e:
        compile_text(bad, restrict=True)
    assert e.value.kind == kind
    compile_text(good, restrict=True)


def test_rules_hold_below_references_and_in_recursive_schemas():
    deep = "start = a  a = element a { b* }  b = element b { c?, a? }  c = element c { d & d }  d = text"
    with pytest.raises(SchemaError) as e:
        compile_text(deep, restrict=True)
    assert e.value.kind == "InterleavedText" and "element c" in str(e.value)
    compile_text(deep.replace("d & d", "d"), restrict=True)
    compile_text("element a { (text & text & notAllowed) | empty }", restrict=True)


def test_competing_elements():
    assert competing(compile_text("element a { element b { text } | element b { empty } }")) == [("a", "b", "b")]
    assert competing(compile_text("element a { element b { text }, element b { text } }")) == []
    assert competing(compile_text("element a { element b { text } | element * { empty } }")) == [("a", "b", "*")]
    assert competing(compile_text("start = r  r = element r { n* }  n = element n { r? } | element n { empty }")) == [("r", "n", "n")]
