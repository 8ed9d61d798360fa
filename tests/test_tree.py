"""Node tables against the automaton: the same documents as rows and as XML."""

import itertools
import os
import random
from collections import Counter
from xml.sax.saxutils import escape, quoteattr

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treegrammar.functions import names as nc
from treegrammar.functions.datatypes import XSD, compile_value
from treegrammar.functions.text import normalize_ws
from treegrammar.operators.tree import TreeGrammar, check, collapsed, fault_counts, faults, identity_faults, tally, validate_tree
from treegrammar.operators.validate import validate_one
from treegrammar.plans import catalogue, tree_queries
from treegrammar.plans.model import compile_text

NODES = "doc long, node string, parent string, pos int, ns string, local string, text string, extra string"
ATTRIBUTES = "doc long, node string, ns string, local string, value string, type int"


def rows(doc, tree, key="r", parent=None, pos=0):
    """tree: (local, attributes, text, children)."""
    local, attributes, text, children = tree
    nodes = [(doc, key, parent, pos, None, local, text, "x")]
    atts = [(doc, key, "", k, v, 1) for k, v in attributes.items()]
    for i, c in enumerate(children):
        n, a = rows(doc, c, f"{key}.{i}", key, i)
        nodes, atts = nodes + n, atts + a
    return nodes, atts


def xml(tree):
    local, attributes, text, children = tree
    return f"<{local}{''.join(f' {k}={quoteattr(v)}' for k, v in attributes.items())}>{escape(text or '')}{''.join(map(xml, children))}</{local}>"


def agree(spark, schema, trees):
    compiled = compile_text(schema)
    nodes, atts = [], []
    for d, t in enumerate(trees):
        n, a = rows(d, t)
        nodes, atts = nodes + n, atts + a
    random.Random(1).shuffle(nodes)
    got = validate_tree(spark.createDataFrame(nodes, NODES), spark.createDataFrame(atts, ATTRIBUTES), compiled)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {r.doc: r.valid for r in got.collect()}
    want = {d: validate_one(xml(t), compiled)[0] for d, t in enumerate(trees)}
    assert got == want, [(xml(trees[d]), want[d]) for d in got if got[d] != want[d]]
    assert len(set(want.values())) == 2, "both answers must occur"


def leafs(*names):
    return [(n, {}, None, []) for n in names]


def test_orders(spark):
    schema = """element order { attribute status { "O" | "F" }, element item { attribute n { xsd:int }, attribute note { text }?, element flag { "R" | "A" }, element qty { xsd:int { maxInclusive = "9" } } }+ }"""
    item = lambda n="1", f="R", q="3", **more: ("item", {"n": n, **more}, None, [("flag", {}, f, []), ("qty", {}, q, [])])
    good = ("order", {"status": "O"}, "\n ", [item(), item("2", "A", "4", note="")])
    trees = [good, ("order", {"status": "O"}, None, []), ("order", {}, None, [item()]), ("order", {"status": "X"}, None, [item()]), ("order", {"status": "F"}, "text", [item()]), ("other", {"status": "F"}, None, [item()])]
    trees += [("order", {"status": "F"}, None, [item("x")]), ("order", {"status": "F"}, None, [item(f="r")]), ("order", {"status": "F"}, None, [item(q="10")]), ("order", {"status": "F"}, None, [item(bad="1")])]
    trees += [("order", {"status": "F"}, None, [("item", {"n": "1"}, None, [("qty", {}, "1", []), ("flag", {}, "R", [])])]), ("order", {"status": "F"}, None, [("item", {"n": "1"}, None, [("flag", {}, "R", [("qty", {}, "1", [])]), ("qty", {}, "1", [])])])]
    agree(spark, schema, trees)


@pytest.mark.parametrize(
    "schema",
    [
        "element a { element x { empty }? & (element y { empty } | element z { empty })* }",
        "element a { (element x { empty }, (element x { empty }, element x { empty }?)?)? & element y { empty }+ }",
        "element a { element x { empty }?, (element y { empty } | element z { empty }, element y { empty })+ }",
        "element a { (element x { empty } | element y { empty })+ & element z { empty } }",
        "element a { (element x { empty }, element x { empty })*, element y { empty }? }",
        "element a { mixed { element x { empty }?, element y { empty }* } }",
        "element a { (element * - (x | y) { empty })*, element x { empty }? }",
    ],
)
def test_words_of_children(spark, schema):
    trees = [("a", {}, None, leafs(*w)) for n in range(5) for w in itertools.product("xyz", repeat=n)] + [("a", {}, "t", leafs("x"))]
    agree(spark, schema, trees)


ITEM = st.sampled_from(["x", "y", "z"]).map(lambda c: f"element {c} {{ empty }}")
PART = st.builds(lambda e, q: f"({e}){q}", st.one_of(ITEM, st.lists(ITEM, min_size=2, max_size=3).map(" | ".join), st.lists(ITEM, min_size=2, max_size=3).map(", ".join)), st.sampled_from(["", "?", "*", "+"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(PART, min_size=1, max_size=3), st.sampled_from(["&", ",", "|"]))
def test_counting_normal_form_takes_the_words_that_the_automaton_takes(parts, op):
    """What counts or a regular expression say, word by word; what they can't say is refused."""
    import re

    compiled = compile_text(f"element a {{ {f' {op} '.join(parts)} }}")
    try:
        grammar = TreeGrammar(compiled)
    except ValueError:
        return
    t = next(t for t in grammar.types[1:] if str(t.names) == "a")
    number = {str(n): k for k, n in t.children.items()}
    for n in range(5):
        for w in itertools.product("xyz", repeat=n):
            want = validate_one(xml(("a", {}, None, leafs(*w))), compiled)[0]
            known = [number.get(c, -1) for c in w]
            if t.counts is not None:
                got = -1 not in known and all(c.least <= (k := sum(x in c.types for x in known)) and (c.most is None or k <= c.most) for c in t.counts)
            else:
                got = -1 not in known and bool(re.fullmatch(t.regex, "".join(chr(0x4E00 + x) for x in known)))
            assert got == want, (w, want, t)


def test_attributes_and_wildcards(spark):
    some = [{}, {"seg": "a"}, {"seg": "a", "extra": "1"}, {"extra": "x"}, {"other": "1"}, {"seg": "", "other": "z", "more": ""}]
    for schema in ("element c { attribute seg { text }, attribute extra { xsd:int }? }", "element c { attribute seg { text }? }", "element c { attribute * - extra { text }* }", "element c { attribute * { text }+ }", "element c { attribute seg { 'a' | empty }?, attribute * - seg { text }+ }"):
        agree(spark, schema, [("c", a, None, []) for a in some])


def test_recursion_and_values(spark):
    schema = "start = r  r = element r { attribute k { text }?, n* }  n = element n { attribute key { xsd:int }, r? }"
    chain = lambda d, last: ("r", {}, None, [("n", {"key": "1"}, None, [chain(d - 1, last)])] if d else last)
    trees = [chain(d, last) for d in (0, 1, 4) for last in ([], leafs("r"), [("n", {"key": "2"}, None, [])], [("n", {}, None, [])])]
    agree(spark, schema, trees)
    agree(spark, "element a { xsd:int - '7' | 'seven' | empty }", [("a", {}, t, []) for t in ("1", "7", "seven", "", " ", "x", None)])
    agree(spark, "element a { text }", [("a", {}, "any", []), ("a", {}, "any", leafs("b")), ("b", {}, "any", [])])


def test_every_fault_is_a_row(spark):
    schema = compile_text("element a { attribute k { xsd:int }, attribute m { text }, element b { 'x' }, element c { empty }* }")
    tree = ("a", {"k": "z", "q": ""}, "text", [("c", {}, None, []), ("b", {}, "y", []), ("d", {}, None, [("e", {}, None, [])]), ("b", {"w": "1"}, "x", [])])
    nodes, atts = rows(1, tree)
    nodes += [(2, "r", None, 0, "urn:n", "a", "", "x"), (3, "r", None, 0, "", "a", "", "x"), (3, "s", None, 0, "", "a", "", "x"), (4, "r", "gone", 0, "", "a", "", "x"), (None, "r", None, 0, "", "zz", "", "x")]
    got = faults(spark.createDataFrame(nodes, NODES), spark.createDataFrame(atts, ATTRIBUTES), schema).collect()
    said = sorted((r.kind, r.node, r.local) for r in got if r.doc == 1)
    assert said == [("attribute", "r", "k"), ("attribute", "r", "q"), ("attribute", "r.3", "w"), ("element-close", "r", "a"), ("element-open-end", "r", "m"), ("element-start", "r.2", "d"), ("text", "r", "a"), ("text", "r.1", "b")]
    assert sorted((r.doc or 0, r.kind) for r in got if r.doc in (2, 4, None)) == [(0, "element-start"), (2, "element-start"), (4, "document"), (4, "orphan")]
    assert [r.kind for r in got if r.doc == 3].count("document") == 1
    empty = spark.createDataFrame([], NODES)
    assert validate_tree(empty, None, schema).collect() == [] == faults(empty, None, schema).collect()


@pytest.mark.parametrize("schema", ["element a { element b { text } | element b { empty }, element c { empty } }", "element a { attribute x { text } | element b { empty } }", "element a { list { xsd:int+ } }", "element a { (element b { empty }, element c { empty }) & element d { empty } }", "element a { attribute x { text } | attribute y { text } }", "element a { xsd:QName 'q' }".replace("xsd:QName 'q'", 'xsd:QName "q"'), "element a { text, element b { empty } }"])
def test_what_it_cannot_say_is_refused(schema):
    with pytest.raises(ValueError):
        TreeGrammar(compile_text(schema))


def test_identities(spark):
    schema = compile_text("element a { (element p { attribute id { xsd:ID }, attribute to { xsd:IDREF | '-' }?, attribute s { text }? } | element q { xsd:IDREF })* }")
    p = lambda **k: ("p", k, None, [])
    q = lambda t: ("q", {}, t, [])
    trees = [("a", {}, None, [p(id="x"), p(id=" x "), p(id="y", to="y", s="x"), p(id="z", to="w"), p(id="u", to="-"), q(" z "), q("v"), q("v"), p(id="1bad", to="2")]), ("a", {}, None, [p(id="v"), q("x")]), ("a", {}, None, [])]
    n, a = zip(*(rows(d, t) for d, t in enumerate(trees)))
    got = identity_faults(spark.createDataFrame(sum(n, []), NODES), spark.createDataFrame(sum(a, []), ATTRIBUTES), schema).collect()
    assert sorted((r.doc, r.kind, r.value, r.node or "") for r in got) == [(0, "dangling-idref", "v", "r.6"), (0, "dangling-idref", "v", "r.7"), (0, "dangling-idref", "w", "r.3"), (0, "duplicate-id", "x", ""), (1, "dangling-idref", "x", "r.1")]
    assert identity_faults(spark.createDataFrame([], NODES), None, schema).collect() == []


def test_name_classes_meet():
    a, q, any_ = nc.Named("", "a"), nc.NsName("urn:q"), nc.AnyName()
    for x, y, want in ((a, a, True), (a, nc.Named("", "b"), False), (a, q, False), (nc.Named("urn:q", "z"), q, True), (q, nc.NsName("urn:r"), False), (any_, q, True), (nc.AnyName(nc.NsName("urn:q")), q, False), (nc.NsName("urn:q", nc.Named("urn:q", "z")), nc.Named("urn:q", "z"), False), (nc.Either(a, q), nc.NsName("urn:q", nc.Named("urn:q", "z")), True)):
        assert nc.overlap(x, y) == want == nc.overlap(y, x)
    assert nc.endless(nc.Either(a, q)) and not nc.endless(nc.Either(a, a))


def test_no_join_goes_through_the_driver(spark):
    """Compressed node tables look small; a join of them must not be sent to the driver and on to all tasks."""
    nodes = spark.createDataFrame([(1, "r", None, 0, "", "land", None, ""), (1, "p", "r", 0, "", "person", None, "")], NODES)
    atts = spark.createDataFrame([(1, "p", "", "id", "x", 1), (1, "p", "", "knows", "y", 1)], ATTRIBUTES)
    schema = compile_text("element land { element person { attribute id { xsd:ID }, attribute knows { xsd:IDREF } }+ }")
    for got, n in ((validate_tree(nodes, atts, schema), 0), (faults(nodes, atts, schema), 0), (identity_faults(nodes, atts, schema), 1)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert got.where("kind is not null" if "kind" in got.columns else "not valid").count() == n


ORDERED = 'element o { attribute s { "O" | "F" }, attribute m { xsd:int }?, element i { attribute n { xsd:int }, element f { "R" | "A" }, (element q { xsd:integer { minInclusive = "1" maxInclusive = "45" } } | element r { empty })* , element g { text }? }+ }'
LOOSE = "element o { (element i { mixed { (element f { empty }, element g { empty })* } } & element q { xsd:int }?) }"


def scattered(rng):
    """Node and attribute rows of odd documents: misplaced, repeated, lost, circular and strange nodes, rows without keys."""
    nodes, atts = [], []
    for d in range(60):
        doc = None if d == 59 else d
        nodes.append((doc, "r", None, None, None, rng.choice("oooooix"), None, "x"))
        atts += [(doc, "r", "", "s", rng.choice(["O", "F", "F", "Z", None]), 1)] * rng.choice([1, 1, 1, 0, 2])
        for k in range(rng.randrange(4)):
            nodes.append((doc, f"i{k}", "r", k, "", rng.choice("iiiiiiq"), rng.choice([None, " ", "t"] if rng.random() < 0.2 else [None]), "x"))
            atts += [(doc, f"i{k}", None, rng.choice("nnnnm"), rng.choice(["1", " 2 ", "z"]), 1)]
            word = rng.choice(["f", "fq", "fqrg", "fg", "frr", "qf", "gf", "fgfg", "x", "fz", ""])
            nodes += [(doc, f"{c}{k}.{j}", f"i{k}", rng.choice([j, j, j, 0, None]), "", c, rng.choice(["R", "1", "45", "46", "007", None, " 3 ", "9" * 40]), "x") for j, c in enumerate(word)]
        if d % 6 == 0:
            odd = [("a", "gone", "i"), ("i0", "r", "i"), ("c", "c", "i"), ("y", "r", "x"), ("z", "y", "x"), ("w", "y", "f"), (None, "r", "i"), (None, None, "o"), ("v", None, "f"), ("u", "i0", "i")]
            nodes += [(doc, n, p, 0, "", local, None, "x") for n, p, local in rng.sample(odd, rng.randrange(1, 4))]
            atts += [(doc, n, "", local, "1", 1) for n, local in rng.sample([(None, "n"), ("gone", "n"), ("y", "n"), ("r", "q"), ("r", None), ("i0", "n")], 2)]
    atts.append((77, "r", "", "s", "O", 1))
    rng.shuffle(nodes)
    return nodes, atts


@pytest.mark.parametrize("schema, pos, owned", [(ORDERED, "int", True), (ORDERED, "string", False), (LOOSE, "int", True)])
def test_counts_of_faults_are_those_of_the_rows(spark, schema, pos, owned):
    compiled = compile_text(schema)
    nodes, atts = scattered(random.Random(len(schema)))
    docs = {n[0] for n in nodes}
    nodes, atts = spark.createDataFrame(nodes, NODES).withColumn("pos", F.col("pos").cast(pos)), spark.createDataFrame(atts, ATTRIBUTES) if owned else None
    every = Counter((r.doc, r.kind) for r in faults(nodes, atts, compiled).collect())
    assert {(r.doc, r.kind): r.faults for r in fault_counts(nodes, atts, compiled).collect()} == every
    summed = Counter()
    for (d, _), n in every.items():
        summed[d] += n
    assert sorted(map(repr, map(tuple, validate_tree(nodes, atts, compiled).collect()))) == sorted(repr((d, not summed[d], summed[d])) for d in docs)
    assert tally(nodes, atts, TreeGrammar(compiled)).where("not doubt").count() > 20


def test_counting_shuffles_only_the_tables(spark, tmp_path):
    """Elements of dealt-out documents are counted where they are: no join, and no shuffle of nodes."""
    spark.createDataFrame([(1, "O"), (2, "X"), (3, "F")], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    items = [(1, 5, 7, 1, 3.0, "R"), (1, 5, 7, 1, 3.0, "R"), (2, 5, 7, 2, 46.0, "Z")]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = tally(*tree_queries.order_tree(spark, str(tmp_path)), TreeGrammar(compile_text(catalogue.ORDER)))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == plan.count("REPARTITION_BY_NUM") == 4
    assert {tuple(r) for r in tree_queries.tree_order_faults(spark, str(tmp_path)).collect()} == {(2, "text", 2), (2, "attribute", 1), (3, "element-close", 1)}
    assert {tuple(r) for r in tree_queries.tree_orders(spark, str(tmp_path)).collect()} == {(1, True), (2, False), (3, False)}


def test_checks_of_texts_are_no_part_of_a_generated_method(spark):
    """A method of more than 8000 bytes is interpreted by the virtual machine instead of compiled."""
    nodes, atts = scattered(random.Random(1))
    found = tally(spark.createDataFrame(nodes, NODES), spark.createDataFrame(atts, ATTRIBUTES), TreeGrammar(compile_text(ORDERED)))
    stages = found._jdf.queryExecution().debug().codegenToSeq()
    for plan in [stages.apply(i) for i in range(stages.length())]:
        assert plan._3().maxMethodCodeSize() < 8000


def test_blanks_of_a_text_are_collapsed_once(spark):
    """All checks of a text share its collapsed form, and elements of orders go by numbers."""
    text, normal = F.col("text"), F.col("normal")
    for t in TreeGrammar(compile_text(catalogue.ORDER)).types:
        for p in [t.text] * bool(t.text) + [a.value for a in t.attributes]:
            assert "regexp_replace" in str(check(p)(text)) and "[" not in str(check(p)(text, normal)).replace("[+-]", "").replace("[0-9]", "")
    sf = "/root/testdata/sf0.001"
    if os.path.exists(sf):
        nodes, atts = tree_queries.order_tree(spark, sf)
        assert {dict(nodes.dtypes)[c] for c in ("doc", "node", "parent")} == {"bigint"} == {dict(atts.dtypes)["node"]}


def test_own_datatypes_take_a_column_alone(spark):
    class Even:
        def check(self, s, *resolve):
            return s.strip() in "02468"

        def column(self, c):
            return F.trim(c).isin(*"02468")

    grammar = check(("choice", (("data", Even()), ("value", compile_value(XSD, "int", "7")))))
    rows = spark.createDataFrame([(" 2 ", "2"), ("3", "3"), (" 07", "07")], "text string, normal string")
    assert [r.ok for r in rows.select(grammar(F.col("text"), F.col("normal")).alias("ok")).collect()] == [True, False, True]


def test_counted_rows_are_narrow(spark):
    """Texts without a blank are not searched, and no counter adds a column to the rows that are counted."""
    rows = spark.createDataFrame([(t,) for t in ["", "a", " a", "a  b", "\ta\n", "a\fb", "\r", "a b ", None]], "t string")
    for r in rows.select(collapsed(F.col("t")).alias("got"), normalize_ws(F.col("t")).alias("want")).collect():
        assert r.got == r.want
    nodes, atts = scattered(random.Random(2))
    found = tally(spark.createDataFrame(nodes, NODES), spark.createDataFrame(atts, ATTRIBUTES), TreeGrammar(compile_text(ORDERED)))
    assert "_common_expr" not in found._jdf.queryExecution().optimizedPlan().toString()
