"""Steps over whole tags against expat."""

import random
from xml.parsers import expat

import pytest

from treegrammar.operators import validate as v
from treegrammar.operators.pool import Pool
from treegrammar.plans.model import compile_text

SCHEMAS = [
    "element a { attribute k { xsd:int }, attribute m { text }?, element b { 'x' }, element c { attribute q { text }, empty }*, element d { element e { xsd:int }+ }? }",
    "element a { mixed { attribute k { text }?, (element b { text } & element c { empty }?)*, element * - (b | c) { attribute * { text }*, text }* } }",
    "start = a a = element a { attribute k { xsd:int }?, text, a* }",
]
PIECES = ["<a>", "<a k='1'>", '<a k="1" m="">', '<a k="z">', "</a>", "<b>x</b>", "<b>y</b>", "<b/>", "<b k='>'/>", '<c q=""/>', "<c/>", '<c q="" ></c >', "<d><e>1</e></d>", "<d><e>w</e><e/></d>", "<d/>", "<f><g/>t<f/>u</f>", "</b>", "t", " ", "\n", "\r\n", "é", "&amp;", "&u;", "<!--c-->", "<![CDATA[x]]>", "]]>", "]", "<p:b/>", '<b xmlns="u"/>', "<a k='1' k='2'/>", "<b q='\t'>x</b>", "<é/>", "<a", ">", "\x01", "\ud800", "￾", "\x7f", "<b>" + "x" * 2000 + "</b>", "<?i?>", "﻿"]


def by_expat(pool, xml):
    run = v.Run(pool)
    try:
        run.all(xml)
        one = (True, *[None] * 8)
    except v.Failure as e:
        one = (False, e.kind, e.message, e.start, e.line, e.col, e.expected, *(run.path[-1] if run.path else (None, None)))
    run = v.Recovering(pool)
    run.all(xml)
    return one, run.found


@pytest.mark.parametrize("schema", SCHEMAS)
def test_results_are_those_of_expat(schema):
    rnd, pool, taken = random.Random(5), Pool(compile_text(schema)), 0
    for i in range(6000):
        most = rnd.choice([20, 26, len(PIECES)])
        inner = "".join(rnd.choice(PIECES[4 if rnd.random() < 0.3 else 5 : most]) for _ in range(rnd.randrange(6)))
        xml = rnd.choice(["", "", "", "", "\n", "<?xml version='1.0'?>"]) + rnd.choice(PIECES[:4]) + inner + rnd.choice(["</a>"] * 6 + ["", "</a>\n", "</a><a/>", "</a>t", "</ a>"])
        if rnd.random() < 0.3:
            at = rnd.randrange(len(xml) + 1)
            xml = xml[:at] + rnd.choice(["", "<", ">", "/", '"', " ", "a"]) + xml[at + 1 :]
        assert (v.validate_text(pool, xml), v.errors_of(pool, xml)) == by_expat(pool, xml), xml
        taken += v.plain(pool, v.Run, xml) is not None
    assert taken > 500
    assert by_expat(pool, "") == (v.validate_text(pool, ""), v.errors_of(pool, ""))


def test_like_documents_are_not_parsed_again(monkeypatch):
    pool, made, make = Pool(compile_text(SCHEMAS[0])), [], expat.ParserCreate
    monkeypatch.setattr(v.expat, "ParserCreate", lambda *a: made.append(1) or make(*a))
    docs = [f'<a k="{i % 7}"><b>{"xy"[i % 2]}</b>{"<c/>" * (i % 3)}<d><e>{i % 50}</e></d></a>' for i in range(1000)]
    kinds = {v.validate_text(pool, d)[1] for d in docs} | {e[1] for d in docs for e in v.errors_of(pool, d)}
    assert kinds == {None, "text", "element-open-end"} and len(made) < 10


def test_what_is_remembered_is_bounded(monkeypatch):
    from treegrammar.operators import plain

    monkeypatch.setattr(plain, "MEMO", 20_000)
    pool = Pool(compile_text(SCHEMAS[2]))
    for i in range(2000):
        assert v.validate_text(pool, f'<a k="{i}">{i}<a>{-i}</a></a>')[0]
    assert len(pool.plain[v.Run].steps) < 200
