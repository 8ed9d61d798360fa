"""Columns and Python checks give the same answer for every type, facet and value."""

import re
from dataclasses import dataclass
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.cloudpickle import dumps, loads
from pyspark.sql import functions as F

from treegrammar.errors import SchemaError
from treegrammar.functions.datatypes import LEXICAL, WHOLE, XSD, compile_datatype, compile_value, register_library
from treegrammar.functions.text import is_whitespace, is_whitespace_column, normalize_whitespace, normalize_ws, parse_entities
from treegrammar.operators.validate import validate_one
from treegrammar.plans.model import compile_text

VALUES = [
    "", " ", "0", "-0", "+0", "1", "+1", "-1", "007", "65535", "65536", "32767", "-32768", "-32769", "2147483648", "4294967295", "4294967296", "9223372036854775807", "-9223372036854775809",
    "18446744073709551615", "18446744073709551616", "9" * 45, "-" + "9" * 45, "12\n", " 12", "1.5", "1.", ".5", "-.50", "1e3", "1E-3", "INF", "-inf", "NaN", "1d", "0x1p3", "१२", "true", "TRUE", "false",
    "2020-02-29", "2021-02-29", "2020-2-3", "-0001-01-01", "2020-12-32", "2020-01-01T10:00:00Z", "2020-01-01T10:00:00.25+02:00", "2020-01-01T10:00:00", "P", "PT", "P1Y", "P1DT", "P1DT2H3.5S", "XP1Y",
    "1" + "0" * 30, "4.9999999999999", "5.0000000000000", "0.0000000000004", "-0.0000000000004", "1" + "0" * 40 + ".2500", "1" + "0" * 40 + ".26", "12.00", "0.5", "-.0", "^", "a$", "bd", "ace", "a&b.-w",
    "2024-01-01Z", " 2024-01-01 ", "2024-01-01+14:00", "2024-01-01+14:30", "0000-01-01", "12024-02-29", "2100-02-29", "2000-02-29", "-0004-02-29", "2024-04-31", "02024-01-01", "2024-13-41T99:99:99Z", "2024-02-29T23:59:59.5-13:59", "2024-01-01T24:00:00", "2024-01-01T24:00:01",
    "-INF", "+INF", "Infinity", "nan", "1.e5", " 5 ", "\t-1.50\n", " true", "en-GB ", "P1Y\n", "+5", " ",
    "en", "en-GB", "toolonglanguage", "http://x.org/a?b#c", "a b", " a  b\tc ", "été", "a:b", "-a", "1a", "_x.y-z", "x" * 300, "\U0001f600", "a b",
]
TYPES = [(n, []) for n in [*WHOLE, "decimal", "double", *LEXICAL, "string", "token", "normalizedString", "ID", "IDREF"]] + [
    ("int", [("minInclusive", "0"), ("maxExclusive", "7")]), ("integer", [("minExclusive", "-" + "9" * 45), ("maxInclusive", "18446744073709551615")]), ("integer", [("maxInclusive", "-1")]), ("integer", [("minInclusive", "0")]),
    ("positiveInteger", [("maxInclusive", "7")]), ("decimal", [("minInclusive", "-0.5"), ("maxInclusive", "1.5")]), ("decimal", [("totalDigits", "2")]), ("decimal", [("fractionDigits", "1")]),
    ("double", [("minExclusive", "0"), ("maxInclusive", "1000")]), ("string", [("length", "1")]), ("string", [("minLength", "2"), ("maxLength", "5")]), ("normalizedString", [("maxLength", "5")]), ("NMTOKENS", [("length", "3")]),
    ("decimal", [("minInclusive", "5")]), ("decimal", [("minExclusive", "0")]), ("decimal", [("maxExclusive", "-0.0000000000001")]), ("decimal", [("maxInclusive", "1" + "0" * 40 + ".25")]), ("decimal", [("minInclusive", ".50"), ("maxInclusive", "0012.0")]),
    ("string", [("pattern", "[a-z ]+"), ("pattern", ".{2,4}")]), ("string", [("pattern", "\\i\\c*")]), ("string", [("pattern", "[a-z-[b-d]]+")]), ("string", [("pattern", "\\d+|\\s+|^|a$")]), ("string", [("pattern", "[^\\d-[0]]*")]), ("string", [("pattern", "\\p{IsBasicLatin}+")]), ("string", [("pattern", "\\p{Lu}+|\\w+")]), ("string", [("pattern", "[\\w\\-&&.]+")]),
    ("string", [("pattern", "[a-z]+")]), ("token", [("pattern", "a b( c)?")]), ("NCName", [("minLength", "3")]),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate([*VALUES, None])], "i int, v string").cache()


@pytest.mark.parametrize("compat", [False, True])
def test_columns_agree_with_checks(frame, compat):
    only_xsd = re.compile(r"\\[icwdpP]|-\[|\^\|")  # compat takes patterns as they are
    wanted = [(n, f) for n, f in TYPES if not compat or not any(only_xsd.search(v) for k, v in f if k == "pattern")]
    types = [compile_datatype(XSD, n, f, compat) for n, f in wanted]
    rows = frame.select("i", *(d.column(F.col("v")).alias(f"t{k}") for k, d in enumerate(types))).collect()
    for r in rows:
        for k, d in enumerate(types):
            want = r.i < len(VALUES) and d.check(VALUES[r.i])
            assert r[f"t{k}"] is want, (wanted[k], VALUES[r.i] if r.i < len(VALUES) else None)


@pytest.mark.parametrize("kind, good, bad", [
    ("date", "2024-01-01 2024-02-29Z 2000-02-29+14:00 12024-12-31-13:59 -0004-02-29", "2023-02-29 1900-02-29 0000-01-01 02024-01-01 2024-04-31 2024-1-1 2024-01-01+14:01 2024-01-01z 2024-00-10"),
    ("dateTime", "2024-02-29T00:00:00 2024-12-31T23:59:59.999Z 2024-01-01T24:00:00 2024-01-01T10:00:00-05:00", "2024-13-41T99:99:99Z 2024-01-01T24:00:01 2024-01-01T10:60:00 2024-01-01T10:00 2023-02-29T10:00:00 2024-01-01 2024-01-01T10:00:60"),
    ("double", "1 -1.5 .5 1. 1e9 1E-9 INF -INF NaN", "inf nan Infinity infinity +INF 1d 0x1p3 . e5"),
    ("int", "1 -1 +1 007", "1.0 1e1"),
])
def test_strict_forms_of_xml_schema(kind, good, bad):
    d = compile_datatype(XSD, kind, [])
    assert [v for v in good.split() if not d.check(v)] == [] == [v for v in bad.split() if d.check(v)]
    assert all(d.check(f" \n{v}\t") for v in good.split())
    loose = compile_datatype(XSD, kind, [], compat=True)
    assert not loose.check(" " + good.split()[0])


TYPED = [("int", "5"), ("int", "+05"), ("int", "-0"), ("integer", "9" * 45), ("unsignedLong", "007"), ("positiveInteger", "1"), ("decimal", "1.5"), ("decimal", "-.50"), ("decimal", "12"), ("decimal", "0.0000000000004"), ("double", "1e3"), ("double", "INF"), ("double", "NaN"), ("double", "0"),
         ("boolean", "1"), ("boolean", "false"), ("date", "2020-02-29"), ("token", " a b "), ("NCName", "en"), ("anyURI", "a:b"), ("string", " ")]


def test_typed_values_agree_with_checks(frame):
    pairs = [compile_value(XSD, n, v) for n, v in TYPED] + [compile_value(XSD, "QName", "p:b", "urn:p"), compile_value(XSD, "QName", "en", "urn:d"), compile_value(XSD, "QName", "en")]
    spaces = {"a": "urn:p", "": "urn:d"}
    rows = frame.where("v is not null").select("i", *(v.column(F.col("v")).alias(f"v{k}") for k, v in enumerate(pairs)), *(v.column(F.col("v"), spaces).alias(f"q{k}") for k, v in enumerate(pairs))).collect()
    for r in rows:
        s = VALUES[r.i]
        for k, v in enumerate(pairs):
            assert r[f"v{k}"] == v.check(s) and r[f"q{k}"] == v.check(s, spaces.get), (v, s)


@given(st.sampled_from(["decimal", "integer", "int", "double"]), st.lists(st.tuples(st.sampled_from("+- "), st.text("0123456789", max_size=30), st.sampled_from(["", "."]), st.text("0459", max_size=20)), min_size=1, max_size=30), st.integers(-(10**25), 10**25), st.integers(0, 12))
@settings(max_examples=12, deadline=None)
def test_numbers_of_any_length(frame, kind, parts, bound, scale):
    texts = [f"{a.strip()}{b}{p}{c}" for a, b, p, c in parts] + [str(bound), "-" + str(bound).lstrip("-")]
    text = str(Decimal(bound).scaleb(-scale)) if kind == "decimal" else str(bound % 2**31) if kind == "int" else str(bound)
    text = format(Decimal(text), "f")
    types = [compile_datatype(XSD, kind, [(k, text)]) for k in ("minInclusive", "minExclusive", "maxInclusive", "maxExclusive")] + [compile_value(XSD, kind, text)]
    rows = frame.sparkSession.createDataFrame([(t,) for t in texts], "v string").select("v", *(d.column(F.col("v")).alias(f"t{k}") for k, d in enumerate(types))).collect()
    for r in rows:
        assert [r[f"t{k}"] for k in range(5)] == [d.check(r.v) for d in types], (kind, text, r.v)


def test_a_library_of_ones_own():
    register_library("urn:colours", lambda name, facets: Colour(name, tuple(facets)), lambda name, value: Colour(name, (("only", value),)))
    schema = compile_text('datatypes c = "urn:colours" element x { attribute a { c:warm "red" }, c:warm }')
    assert [validate_one(f"<x a='{a}'>{t}</x>", schema)[0] for a, t in (("red", "red"), ("red", "amber"), ("amber", "red"), ("red", "blue"))] == [True, True, False, False]
    assert loads(dumps(schema)).rules == schema.rules
    with pytest.raises(ValueError):
        register_library(XSD, Colour, Colour)
    with pytest.raises(SchemaError):
        compile_text('datatypes c = "urn:unknown" element x { c:warm }')


@dataclass(frozen=True)
class Colour:
    name: str
    facets: tuple

    def check(self, s, *_):
        return s in ("red", "amber") and all(v == s for _, v in self.facets)

    def column(self, c):
        return c.isin("red", "amber")


def test_limits():
    d = compile_datatype(XSD, "decimal", [("minInclusive", "1.5"), ("totalDigits", "4"), ("pattern", "[0-9.]+")])
    assert d.limits() == {"minInclusive": Decimal("1.5"), "totalDigits": 4, "pattern": ["[0-9.]+"]}


def test_values_and_text_functions(frame):
    pairs = [compile_value("", "string", " a  b\tc "), compile_value("", "token", "a b c"), compile_value(XSD, "token", "a b c"), compile_value(XSD, "string", "en")]
    rows = frame.where("v is not null").select("i", *(v.column(F.col("v")).alias(f"v{k}") for k, v in enumerate(pairs)), normalize_ws(F.col("v")).alias("n"), is_whitespace_column(F.col("v")).alias("w")).collect()
    for r in rows:
        s = VALUES[r.i]
        assert [r[f"v{k}"] for k in range(4)] == [v.check(s) for v in pairs]
        assert r.n == normalize_whitespace(s) and r.w == is_whitespace(s)
    assert compile_value(XSD, "int", "5").check(" +05 ") and not compile_value("", "token", "5").check("05")
    assert compile_value(XSD, "QName", "p:x", "urn:p").check("q:x", {"q": "urn:p"}.get)


@pytest.mark.parametrize("raw,want", [("", ""), (" ", ""), ("  ", ""), ("a ", "a"), (" a", "a"), ("a a", "a a"), ("\na\t a\r", "a a")])
def test_normalize(raw, want):
    assert normalize_whitespace(raw) == want


def test_entities():
    assert parse_entities("foo &bar; blat") == [("text", 0, "foo "), ("entity", 5, "bar"), ("text", 9, " blat")]
    assert parse_entities("&#65;&#x1F600;") == [("char", 1, "A"), ("char", 6, "\U0001f600")]
    for bad in ("&", "&;", "&#xD800;", "&#zz;", "a &b"):
        with pytest.raises(ValueError):
            parse_entities(bad)
