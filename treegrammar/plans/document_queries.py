"""Queries over the test tables through entities, blanks, qualified names and quoted keywords, conformance suites, and tables of facets and error places.

The SQL states the same rows from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from treegrammar.operators.validate import validate
from treegrammar.plans import catalogue, graph
from treegrammar.plans.model import compile_schema, compile_text
from treegrammar.sources.schemas import Memory
from treegrammar.sources.suite import run_suites

QUERIES: dict[str, catalogue.Query] = {}
ORACLES: dict[str, str] = {}
RNG = 'xmlns="http://relaxng.org/ns/structure/1.0"'


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def _text(*parts):
    """Strings and columns joined."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# ---------------------------------------------------------------- documents


@query("entities_defined", """SELECT c_custkey, k = 4 OR k <= 3 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AS valid,
  CASE WHEN k = 5 THEN 'undefined_entity' WHEN k = 6 THEN 'external_entity' WHEN k = 7 THEN 'xml' WHEN k <= 3 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'text' END AS error_kind
  FROM (SELECT c_custkey, c_mktsegment, c_custkey % 8 AS k FROM customer)""")
def entities_defined(spark, sf_dir):
    """Segments written through entities of the document, of one another, and as decimal and hexadecimal numbers; undefined, external and impossible ones."""
    k, segment = F.col("c_custkey") % 8, F.col("c_mktsegment")
    first, rest = F.ascii(segment), segment.substr(F.lit(2), F.length(segment))
    xml = (
        F.when(k == 0, _text('<!DOCTYPE s [<!ENTITY e "', segment, '">]><s>&e;</s>'))
        .when(k == 1, _text('<!DOCTYPE s [<!ENTITY e "&f;', rest, '"><!ENTITY f "', F.substring(segment, 1, 1), '">]><s>&e;</s>'))
        .when(k == 2, _text("<s>&#", first, ";", rest, "</s>"))
        .when(k == 3, _text("<s>&#x", F.hex(first), ";", rest, "</s>"))
        .when(k == 4, F.lit("<s>BUILD&amp;&lt;&gt;&quot;&apos;ING</s>"))
        .when(k == 5, _text("<s>&e;", segment, "</s>"))
        .when(k == 6, _text('<!DOCTYPE s [<!ENTITY e SYSTEM "gone.txt">]><s>', segment, "</s>"))
        .otherwise(_text("<s>&#xD800;", segment, "</s>"))
    )
    schema = compile_text("element s { 'BUILDING' | 'MACHINERY' | 'BUILD&<>\"' ~ \"'ING\" }")
    docs = catalogue.table(spark, sf_dir, "customer").select("c_custkey", xml.alias("xml"))
    return validate(docs, schema, "c_custkey").select("c_custkey", "valid", "error_kind")


@query("blanks_between", "SELECT p_partkey, p_partkey % 4 <> 3 AND p_size <= 40 AS valid FROM part")
def blanks_between(spark, sf_dir):
    """Blanks around elements and in an empty one don't count; other text does."""
    gap = F.when(F.col("p_partkey") % 4 == 0, " \n\t").when(F.col("p_partkey") % 4 == 1, "&#32;<!-- c -->\r\n").when(F.col("p_partkey") % 4 == 2, "").otherwise(F.lit(" x "))
    xml = _text("<p>", gap, "<none>", F.when(F.col("p_partkey") % 2 == 0, " \n").otherwise(""), "</none>", gap, "<size> ", F.col("p_size"), "\n</size> </p>")
    schema = compile_text("element p { element none { empty }, element size { xsd:int { maxInclusive = '40' } } }")
    return validate(catalogue.table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml")), schema, "p_partkey").select("p_partkey", "valid")


@query("value_qname", "SELECT n_nationkey, n_regionkey IN (0, 2) AS valid FROM nation")
def value_qname(spark, sf_dir):
    """A qualified name as a value: its namespace counts, not its prefix."""
    r = F.col("n_regionkey")
    xml = F.when(r == 0, '<q xmlns:a="urn:n">a:x</q>').when(r == 1, '<q xmlns:n="urn:other">n:x</q>').when(r == 2, '<q><v xmlns="urn:n"> x </v></q>').when(r == 3, "<q>x</q>").otherwise(F.lit("<q>n:x</q>"))
    schema = compile_text("namespace n = 'urn:n' datatypes d = 'http://www.w3.org/2001/XMLSchema-datatypes' element q { d:QName 'n:x' | element n:v { d:QName 'n:x' } }")
    return validate(catalogue.table(spark, sf_dir, "nation").select("n_nationkey", xml.alias("xml")), schema, "n_nationkey").select("n_nationkey", "valid")


@query("names_quoted", "SELECT n_nationkey, n_regionkey < 3 AND n_name NOT IN ('BRAZIL', 'JAPAN') AS valid FROM nation")
def names_quoted(spark, sf_dir):
    """Keywords as names, the built-in string and token, another prefix for a datatype library, and namespaces that an include inherits."""
    files = {
        "m.rnc": "default namespace n = 'urn:n' include 'part.rnc' inherit = n  \\list = attribute text { string - 'BRAZIL' }",
        "part.rnc": "datatypes d = 'http://www.w3.org/2001/XMLSchema-datatypes' start = \\element  \\element = element list { attribute empty { d:integer { maxExclusive = '3' } }, \\list, element \\mixed { token - string 'JAPAN' } }",
    }
    xml = _text('<list xmlns="urn:n" empty="', F.col("n_regionkey"), '" text="', F.col("n_name"), '"><mixed>', F.col("n_name"), "</mixed></list>")
    return validate(catalogue.table(spark, sf_dir, "nation").select("n_nationkey", xml.alias("xml")), compile_schema("m.rnc", Memory(files)), "n_nationkey").select("n_nationkey", "valid")


@query("xml_base", "SELECT n_nationkey, n_regionkey <= 3 AS valid FROM nation")
def xml_base(spark, sf_dir):
    """References of schemas in the XML syntax that are rebased, twice and by an absolute path."""
    files = {
        "m.rng": f'<grammar {RNG} xml:base="lib/"><include href="a.rng" xml:base="deep/"/><div xml:base="/top/"><include href="b.rng"/></div></grammar>',
        "lib/deep/a.rng": f'<grammar {RNG}><start><ref name="land"/></start></grammar>',
        "/top/b.rng": f'<grammar {RNG} datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes"><define name="land"><element name="land"><data type="int"><param name="maxInclusive">3</param></data></element></define></grammar>',
    }
    xml = _text("<land>", F.col("n_regionkey"), "</land>")
    return validate(catalogue.table(spark, sf_dir, "nation").select("n_nationkey", xml.alias("xml")), compile_schema("m.rng", Memory(files)), "n_nationkey").select("n_nationkey", "valid")


@query("suite_outcomes", """SELECT n_nationkey, 0 AS nth, 'correct' AS kind, CASE WHEN n_regionkey = 2 THEN 'passed' WHEN n_regionkey < 2 THEN 'invalid 0' ELSE 'valid 0' END AS outcome FROM nation
  UNION ALL SELECT n_nationkey, 1, 'incorrect', CASE WHEN n_nationkey % 3 = 0 THEN 'schema accepted' ELSE 'passed' END FROM nation
  UNION ALL SELECT n_nationkey, 2, 'correct', 'schema: UndefinedReference' FROM nation WHERE n_nationkey % 4 = 0""")
def suite_outcomes(spark, sf_dir):
    """A conformance suite for each nation, read and run on the executors: right, wrong and broken cases."""
    least = lambda n: f'<element {RNG} name="a" datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes"><data type="int"><param name="minInclusive">{n}</param></data></element>'
    r, key = F.col("n_regionkey"), F.col("n_nationkey")
    first = _text("<testSuite><testSuite><testCase><section>1</section><resource name=\"low.rng\">", least(2), f'</resource><correct><externalRef {RNG} href="low.rng"/></correct><valid><a>', F.when(r <= 2, F.lit(2)).otherwise(F.lit(1)), "</a></valid><invalid><a>", F.when(r < 2, F.lit(3)).otherwise(F.lit(1)), "</a></invalid></testCase></testSuite>")
    second = _text(f"<testCase><incorrect><element {RNG} name=\"a\">", F.when(key % 3 == 0, "<text/>").otherwise(""), "</element></incorrect></testCase>")
    third = F.when(key % 4 == 0, f'<testCase><correct><grammar {RNG}><start><ref name="b"/></start></grammar></correct><valid><a/></valid></testCase>').otherwise(F.lit(""))
    suites = catalogue.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(first, second, third, F.lit("</testSuite>")).alias("text"))
    return run_suites(suites, "n_nationkey").select("n_nationkey", "nth", "kind", "outcome")


# ---------------------------------------------------------------- schemas

_FILES = {
    "twice.rnc": "a = text start = a",
    "deeper.rnc": "include 'deep.rnc'",
    "deep.rnc": "start = element a { b }",
    "fine.rnc": "start = element a { text }",
}


@query("schema_error_places", """SELECT n_nationkey, t.n::INTEGER AS n, t.note, t.file, t.at::INTEGER AS start, (t.at + t.long)::INTEGER AS "end" FROM (SELECT *, n_nationkey % 5 AS k, 'r' || n_nationkey AS own FROM nation) JOIN (VALUES
  (0, 0, 'here', 'schema', 'own', 1), (0, 1, 'first defined here', 'twice.rnc', '', 1),
  (1, 0, 'here', 'deep.rnc', 'b', 1), (1, 1, 'included here', 'deeper.rnc', '', 7), (1, 2, 'included here', 'schema', 'own', 7),
  (2, 0, 'here', 'schema', 'first', 0), (2, 1, 'by way of two', 'schema', 'second', 3),
  (3, 0, 'here', 'gone.rnc', '', 0), (3, 1, 'used here', 'schema', 'own', 8)) AS v(k0, n, note, file, place, size) ON k = k0,
  LATERAL (SELECT v.n, v.note, v.file, CASE place WHEN 'own' THEN CASE k WHEN 0 THEN length(own) + 23 WHEN 1 THEN length(own) + 3 ELSE length(own) + 17 END WHEN 'b' THEN 20 WHEN 'first' THEN 8 WHEN 'second' THEN 12 + 2 * length(own) ELSE 0 END AS at, CASE WHEN place = 'first' THEN length(own) ELSE size END AS long) AS t""")
def schema_error_places(spark, sf_dir):
    """Where each nation's schema goes wrong: the place itself, the first definition or the rules of a cycle, and the includes that led there."""
    k, own = F.col("n_nationkey") % 5, _text("r", F.col("n_nationkey"))
    text = (
        F.when(k == 0, _text("# ", own, "\ninclude 'twice.rnc' a = empty"))
        .when(k == 1, _text("# ", own, "\ninclude 'deeper.rnc'"))
        .when(k == 2, _text("start = ", own, " ", own, " = two? two = ", own))
        .when(k == 3, _text("start = element ", own, "{external 'gone.rnc'}"))
        .otherwise(F.lit("include 'fine.rnc'"))
    )
    return graph.places(catalogue.table(spark, sf_dir, "nation").select("n_nationkey", text.alias("text")), "n_nationkey", files=_FILES)


@query("schema_facets", """SELECT n_nationkey, rule, nth::INTEGER AS nth, type, facet, value FROM nation, LATERAL (VALUES
  ('start', 0, 'short', 'minExclusive', n_nationkey::VARCHAR), ('start', 0, 'short', 'min', (n_nationkey + 1)::VARCHAR), ('start', 0, 'short', 'max', '32767'),
  ('start', 1, 'token', 'length', n_regionkey::VARCHAR), ('start', 1, 'token', 'min_length', n_regionkey::VARCHAR), ('start', 1, 'token', 'max_length', n_regionkey::VARCHAR),
  ('a', 0, 'decimal', 'maxExclusive', n_regionkey || '.5'), ('a', 0, 'decimal', 'fractionDigits', '1'), ('a', 0, 'decimal', 'max', n_regionkey || '.5'),
  ('a', 1, 'string', 'pattern', n_name || '+'), ('a', 1, 'string', 'maxLength', '9'), ('a', 1, 'string', 'max_length', '9'),
  ('b', 0, 'token', NULL, NULL), ('b', 1, 'integer', NULL, NULL)) AS t(rule, nth, type, facet, value)""")
def schema_facets(spark, sf_dir):
    """What the datatypes of each nation's schema demand, as a table."""
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    text = _text("start = element x { attribute y { xsd:short { minExclusive = '", key, "' } }?, (list { xsd:token { length = '", region, "' } } | a) } a = element a { xsd:decimal { maxExclusive = '", region,
                 ".5' fractionDigits = '1' } - '0' | element c { xsd:string { pattern = '", F.col("n_name"), "+' maxLength = '9' } } } b = element b { token | xsd:integer }")
    return graph.facets(catalogue.table(spark, sf_dir, "nation").select("n_nationkey", text.alias("text")), "n_nationkey").drop("library")
