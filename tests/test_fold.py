"""The folded automaton against the pool."""

import itertools
import random

import pytest

from treegrammar.operators.fold import automaton, fold_valid
from treegrammar.operators.validate import validate_one
from treegrammar.plans import catalogue
from treegrammar.plans.model import compile_text
from pyspark.sql import functions as F

SCHEMAS = [
    "element a { (element x { empty }, element y { empty })+ }",
    "element a { element x { empty }? & (element y { empty } | element z { text })* & element x { empty } }",
    "element a { (element x { empty }, element x { empty })*, element * - (x | y) { empty }? }",
    "element a { (element x { empty } | (element x { empty }, element y { empty }))+, element y { empty } }",
    "element a { empty }",
    "start = r  r = element a { (x, x?)* & y }  x = element x { r? }  y = element y { empty }?",
]


@pytest.mark.parametrize("schema", SCHEMAS)
def test_words(spark, schema):
    compiled = compile_text(schema)
    a = automaton(compiled, "a")
    words = [list(w) for n in range(5) for w in itertools.product("xyzq", repeat=n)]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(-1, None), (-2, [None])], "i int, w array<string>")
    got = {r.i: r.v for r in rows.select("i", fold_valid(F.col("w"), a).alias("v")).collect()}
    for i, w in enumerate(words):
        want = validate_one("<a>" + "".join(f"<{c}/>" for c in w) + "</a>", compiled)[0]
        assert got[i] is want is a.accepts(w), w
    assert got[-1] is None and got[-2] is a.accepts(["\0"])


def test_long_words_and_many_states(spark):
    loose = compile_text(catalogue.LOOSE_INTERLEAVE)
    a, rnd = automaton(loose, "log"), random.Random(2)
    assert 17**3 <= len(a.accepting) <= 17**3 + 2
    words = [[rnd.choice(["view", "click", "error", "signup", "purchase"]) for _ in range(rnd.randrange(90))] for _ in range(60)]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w array<string>")
    got = {r.i: r.v for r in rows.select("i", fold_valid(F.col("w"), a).alias("v")).collect()}
    want = {i: validate_one("<log>" + "".join(f"<{c}/>" for c in w) + "</log>", loose)[0] for i, w in enumerate(words)}
    assert got == want and len(set(want.values())) == 2


@pytest.mark.parametrize("schema", ["element a { attribute k { text }? }", "element a { text }", "element a { element x { attribute k { text } } }", "element a { element x { element y { empty } } }", "element b { empty }"])
def test_what_it_cannot_see_is_refused(schema):
    with pytest.raises(ValueError):
        automaton(compile_text(schema), "a")


def test_more_states_than_allowed_is_an_error():
    with pytest.raises(ValueError, match="more than 100 states"):
        automaton(compile_text(catalogue.LOOSE_INTERLEAVE), "log", most=100)
