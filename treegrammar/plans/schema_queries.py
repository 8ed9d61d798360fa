"""Queries over the test tables through the XML syntax, includes, externals, nested grammars and combination, and of schema errors.

The SQL states the same rows from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treegrammar.errors import SchemaError
from treegrammar.functions.sql import register_valid, tokens
from treegrammar.operators.scopes import raw_tokens, resolved, undefined
from treegrammar.operators.validate import all_errors, validate
from treegrammar.operators.pool import Pool
from treegrammar.plans import catalogue, graph, tree_queries
from treegrammar.plans.model import compile_schema, compile_text
from treegrammar.sources.documents import escaped, order_docs
from treegrammar.sources.schemas import Memory
from treegrammar.streaming.tokens import part_rows, validate_parts

QUERIES: dict[str, catalogue.Query] = {}
ORACLES: dict[str, str] = {}
RNG = 'xmlns="http://relaxng.org/ns/structure/1.0"'
XSD = 'datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes"'


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


#: catalogue.ORDER in the XML syntax.
ORDER_XML = f"""<element name="order" {RNG} {XSD}>
  <attribute name="status"><choice><value type="token">O</value><value type="token">F</value><value type="token">P</value></choice></attribute>
  <oneOrMore><element name="item"><attribute name="n"><data type="int"/></attribute>
    <element name="flag"><choice><value>R</value><value>A</value><value>N</value></choice></element>
    <element name="qty"><data type="integer"><param name="minInclusive">1</param><param name="maxInclusive">45</param></data></element>
  </element></oneOrMore></element>"""


@query("validate_order_docs_xml", catalogue.ORACLES["validate_order_docs"])
def validate_order_docs_xml(spark, sf_dir):
    return validate(order_docs(spark, sf_dir), compile_text(ORDER_XML, "xml"), "o_orderkey").select("o_orderkey", "valid")


@query("sql_valid", catalogue.ORACLES["validate_order_docs"])
def sql_valid(spark, sf_dir):
    """Validity as a function of Spark SQL."""
    register_valid(spark, compile_text(catalogue.ORDER), "rng_valid_order")
    return order_docs(spark, sf_dir).select("o_orderkey", F.expr("rng_valid_order(xml)").alias("valid"))


@query("order_all_errors", f"SELECT o_orderkey, coalesce(max(faults), 0)::BIGINT AS errors, coalesce(max(kind), '') AS kinds FROM orders LEFT JOIN (SELECT o_orderkey AS k, sum(faults) AS faults, string_agg(kind, ' ' ORDER BY kind) AS kind FROM ({tree_queries.ORACLES['tree_order_faults']}) GROUP BY o_orderkey) ON k = o_orderkey GROUP BY o_orderkey")
def order_all_errors(spark, sf_dir):
    """How many errors each order's document has, and of which kinds: validation goes on after each of them."""
    found = all_errors(order_docs(spark, sf_dir), compile_text(catalogue.ORDER), "o_orderkey")
    found = found.groupBy("o_orderkey").agg(F.count("*").alias("errors"), F.array_join(F.array_sort(F.collect_set("error_kind")), " ").alias("kinds"))
    orders = catalogue.table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    return orders.join(found, "o_orderkey", "left").select("o_orderkey", F.coalesce("errors", F.lit(0)).cast("long").alias("errors"), F.coalesce("kinds", F.lit("")).alias("kinds"))


def nation_docs(spark, sf_dir) -> DataFrame:
    """<land key= name=?><text/>..: every fifth nation has no name, every third a note in another namespace, every fourth a second size."""
    key = F.col("n_nationkey")
    name = F.when(key % 5 != 0, F.concat(F.lit(' name="'), escaped(F.col("n_name")), F.lit('"'))).otherwise("")
    note = F.when(key % 3 == 0, F.lit('<x:note xmlns:x="urn:x">t</x:note>')).otherwise("")
    size = F.when(key % 4 == 0, F.lit("<size>1</size><size>2</size>")).otherwise(F.lit("<size>1</size>"))
    xml = F.concat(F.lit('<land key="'), key.cast("string"), F.lit('"'), name, F.lit(">"), size, note, F.lit("</land>"))
    return catalogue.table(spark, sf_dir, "nation").select("n_nationkey", xml.alias("xml"))


def _nations(name: str, files: dict[str, str], main: str, sql: str) -> None:
    query(name, f"SELECT n_nationkey, {sql} AS valid FROM nation")(lambda spark, sf_dir: validate(nation_docs(spark, sf_dir), compile_schema(main, Memory(files)), "n_nationkey").select("n_nationkey", "valid"))


_BASE = "start = land  land = element land { attribute key { xsd:int }, name, sizes, notes }  name = attribute name { text }  sizes = element size { xsd:int }  notes = empty"
_NOTE = "namespace x = 'urn:x' element x:note { text }"
_nations("schema_include", {"m.rnc": "include 'base.rnc'", "base.rnc": _BASE}, "m.rnc", "n_nationkey % 5 <> 0 AND n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 0")
_nations("schema_include_override", {"m.rnc": "include 'base.rnc' { name = attribute name { text }? div { sizes = element size { xsd:int }+ } }", "base.rnc": _BASE}, "m.rnc", "n_nationkey % 3 <> 0")
_nations("schema_external", {"m.rnc": "include 'base.rnc' { notes = external 'lib/note.rnc'? }", "base.rnc": _BASE, "lib/note.rnc": _NOTE}, "m.rnc", "n_nationkey % 5 <> 0 AND n_nationkey % 4 <> 0")
_nations("schema_combine", {"m.rnc": "include 'base.rnc' { name = notAllowed } name |= attribute name { text } name |= empty sizes &= element size { xsd:int }? notes |= external 'note.rnc'", "base.rnc": _BASE.replace("key { xsd:int }", "key { xsd:int - '9' }").replace("sizes =", "sizes &=").replace("notes =", "notes |=").replace("name =", "name |="), "note.rnc": _NOTE}, "m.rnc", "n_nationkey <> 9")
_nations("schema_nested_parent", {"m.rnc": "start = element land { grammar { start = attribute key { parent number }, attribute name { text }, sizes  sizes = element size { parent number }+ }, (external 'note.rnc')? }  number = xsd:int { maxInclusive = '17' }", "note.rnc": _NOTE}, "m.rnc", "n_nationkey % 5 <> 0 AND n_nationkey <= 17")
_nations("schema_name_classes", {"m.rnc": "namespace x = 'urn:x' namespace n = '' start = element * - x:* { attribute (key | name) { text }+, element n:* - (other | n:none) { text }, element (x:note | other) { text }? }"}, "m.rnc", "n_nationkey % 4 <> 0")
_nations("schema_annotated", {"m.rnc": "# a comment\n## documentation\nnamespace a = 'urn:a' [ a:x = '1' ] start = [ a:note [ 'n' ] ] element land { attribute key { xsd:int { maxInclusive = '19' } } >> a:after [ ], attribute name { 'NATION' ~ '_' ~ '1' | text }?, \\element }  \\element = element size { text }+, (" + _NOTE.split("' ", 1)[1].replace("x:note", "*") + ")?"}, "m.rnc", "n_nationkey <= 19")
_PATTERN = f"""<grammar {RNG} {XSD} xmlns:x="urn:x" xmlns:doc="urn:doc">
<doc:about>taken out</doc:about>
<include href="part.rng"><define name="name"><optional><attribute><name>name</name><text/></attribute></optional></define></include>
<div><define name="notes" combine="choice"><externalRef href="note.rng"/></define></div>
<start combine="choice"><notAllowed/></start></grammar>"""
_PART = f"""<grammar {RNG} {XSD}><start combine="choice"><ref name="land"/></start>
<define name="land"><element name="land"><interleave><attribute name="key"><data type="int"><except><value>7</value></except></data></attribute><ref name="name"/></interleave>
<grammar><start><oneOrMore><element name="size"><parentRef name="number"/></element></oneOrMore></start></grammar><ref name="notes"/></element></define>
<define name="number"><list><data type="int"/></list></define><define name="name"><attribute name="name"/></define><define name="notes" combine="choice"><empty/></define></grammar>"""
_NOTE_XML = f'<element {RNG} ns="urn:x"><choice><nsName><except><name>none</name></except></nsName><anyName><except><nsName/><nsName ns=""/></except></anyName></choice><mixed><zeroOrMore><group><empty/></group></zeroOrMore></mixed></element>'
_nations("schema_xml_forms", {"m.rng": _PATTERN, "part.rng": _PART, "note.rng": _NOTE_XML}, "m.rng", "n_nationkey <> 7")

#: Expected kind of error -> files of a schema.
BROKEN = {
    "UndefinedReference": {"m.rnc": "start = a"},
    "StartRuleMissing": {"m.rnc": "a = empty"},
    "DuplicateDefinition": {"m.rnc": "start = empty start = text"},
    "ConflictingCombine": {"m.rnc": "start |= empty start &= text"},
    "RecursiveReference": {"m.rnc": "start = a a = b b = a?"},
    "RecursiveInclude": {"m.rnc": "include 'm.rnc'"},
    "DefineNotFound": {"m.rnc": "include 'n.rnc' { x = empty }", "n.rnc": "start = empty"},
    "ExpectedGrammar": {"m.rnc": "include 'n.rnc'", "n.rnc": "element a { empty }"},
    "NoParentScope": {"m.rnc": "start = parent a"},
    "UndefinedNamespacePrefix": {"m.rnc": "element p:a { empty }"},
    "UndefinedDatatypePrefix": {"m.rnc": "element a { q:int }"},
    "UnsupportedDatatypeLibrary": {"m.rnc": "datatypes q = 'urn:q' element a { q:int }"},
    "UnsupportedDatatype": {"m.rnc": "element a { xsd:hexBinary }"},
    "InvalidFacet": {"m.rnc": "element a { xsd:int { length = '1' } }"},
    "InvalidInt": {"m.rnc": "element a { xsd:int { minInclusive = 'x' } }"},
    "InvalidPattern": {"m.rnc": "element a { xsd:string { pattern = '(' } }"},
    "ConflictingFacet": {"m.rnc": "element a { xsd:string { minLength = '3' maxLength = '2' } }"},
    "ParamNotAllowed": {"m.rnc": "element a { string { length = '1' } }"},
    "ElementInAttribute": {"m.rnc": "element a { attribute b { element c { empty } } }"},
    "DatatypesPrefixRedefined": {"m.rnc": "datatypes xsd = 'urn:x' element a { empty }"},
    "Parse": {"m.rnc": "element a {"},
    "Io": {"m.rnc": "include 'gone.rnc'"},
    "InvalidName": {"m.rng": f'<element name="a" {RNG}><attribute name="xmlns"/></element>'},
    "UnexpectedElement": {"m.rng": f'<element name="a" {RNG}><text><text/></text></element>'},
    "UnexpectedAttribute": {"m.rng": f'<element name="a" b="" {RNG}><empty/></element>'},
    "InvalidCombine": {"m.rng": f'<grammar {RNG}><start combine="x"><empty/></start></grammar>'},
    "InvalidDatatypeLibrary": {"m.rng": f'<element name="a" datatypeLibrary="x#y" {RNG}><empty/></element>'},
    "XmlParse": {"m.rng": "<element"},
}


BROKEN_KINDS = list(BROKEN)


@query("schema_error_kinds", f"SELECT p_partkey, kind FROM part JOIN (VALUES {', '.join(f'({i}, {catalogue.quoted(k)})' for i, k in enumerate(BROKEN))}) AS t(n, kind) ON p_partkey % {len(BROKEN)} = n")
def schema_error_kinds(spark, sf_dir):
    """Every part names one of the broken schemas: what compiling it on the executors says."""
    which = catalogue.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(BROKEN)).cast("string").alias("n"))

    def kind(n: str) -> list[tuple]:
        files = BROKEN[BROKEN_KINDS[int(n)]]
        try:
            compile_schema(next(iter(files)), Memory(files))
        except SchemaError as e:
            return [(e.kind,)]
        return []

    return graph.each(which, "kind string", kind, "p_partkey", "n")


#: Six rules for each nation; rule i refers to one that depends on the nation, and the start to one of them.
_RULES = 6


def nation_schemas(spark, sf_dir) -> DataFrame:
    key = F.col("n_nationkey")
    rule = lambda i: F.concat(F.lit(f" r{i} = element e{i} {{ r"), ((key + 2 * i) % _RULES).cast("string"), F.lit("? }"))
    text = F.concat(F.lit("start = r"), (key % _RULES).cast("string"), *(rule(i) for i in range(_RULES)), F.when(key % 3 == 0, F.lit(" extra = empty")).otherwise(F.lit("")))
    return catalogue.table(spark, sf_dir, "nation").select("n_nationkey", text.alias("text"))


_GRAPH = f"""WITH RECURSIVE edges AS (SELECT n_nationkey, 'r' || i AS rule, 'r' || ((n_nationkey + 2 * i) % {_RULES}) AS target FROM nation, range({_RULES}) t(i)),
  reach AS (SELECT n_nationkey, 'r' || (n_nationkey % {_RULES}) AS rule FROM nation UNION SELECT e.n_nationkey, e.target FROM reach r JOIN edges e ON e.n_nationkey = r.n_nationkey AND e.rule = r.rule),
  way AS (SELECT n_nationkey, rule, target FROM edges UNION SELECT w.n_nationkey, w.rule, e.target FROM way w JOIN edges e ON e.n_nationkey = w.n_nationkey AND e.rule = w.target) """


@query("schema_unused", _GRAPH + "SELECT n_nationkey, rule AS name FROM edges e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.n_nationkey = e.n_nationkey AND r.rule = e.rule) UNION ALL SELECT n_nationkey, 'extra' FROM nation WHERE n_nationkey % 3 = 0")
def schema_unused(spark, sf_dir):
    """Definitions that no start leads to."""
    texts = nation_schemas(spark, sf_dir)
    return graph.unused(graph.rules(texts, "n_nationkey"), graph.edges(texts, "n_nationkey"), "n_nationkey").select("n_nationkey", "name")


@query("schema_recursive", _GRAPH + "SELECT n_nationkey, rule AS name FROM way WHERE rule = target")
def schema_recursive(spark, sf_dir):
    """Rules that lead to themselves."""
    texts = nation_schemas(spark, sf_dir)
    return graph.recursive(graph.rules(texts, "n_nationkey"), graph.edges(texts, "n_nationkey"), "n_nationkey").select("n_nationkey", "name")


@query("schema_tree", f"SELECT n_nationkey, kind, (n + CASE WHEN n_nationkey % 3 = 0 AND kind IN ('Define', 'Empty') THEN 1 ELSE 0 END)::BIGINT AS nodes FROM nation, (VALUES ('Schema', 1), ('Grammar', 1), ('Define', {_RULES + 1}), ('Ref', {_RULES + 1}), ('Element', {_RULES}), ('NcName', {_RULES}), ('Name', {_RULES}), ('Repeat', {_RULES}), ('Empty', 0)) t(kind, n) WHERE kind <> 'Empty' OR n_nationkey % 3 = 0")
def schema_tree(spark, sf_dir):
    """The syntax trees of all schemas as one table, counted by kind of node."""
    return graph.tree_nodes(nation_schemas(spark, sf_dir), "n_nationkey").groupBy("n_nationkey", "kind").agg(F.count("*").alias("nodes"))


@query("schema_loaded", "SELECT n_nationkey, 'lib' || (n_nationkey % 3) || '.rnc' AS path FROM nation UNION ALL SELECT n_nationkey, 'note.rnc' FROM nation WHERE n_nationkey % 3 = 2")
def schema_loaded(spark, sf_dir):
    """The files that each schema includes, directly or not."""
    files = {"lib0.rnc": "start = element a { empty }", "lib1.rnc": "start = element b { text }", "lib2.rnc": "start = element c { external 'note.rnc' }", "note.rnc": "element note { text }"}
    texts = catalogue.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("include 'lib"), (F.col("n_nationkey") % 3).cast("string"), F.lit(".rnc'")).alias("text"))
    return graph.loaded(texts, files, "n_nationkey")


@query("schema_errors", "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 1 THEN 'UndefinedReference' WHEN 2 THEN 'DuplicateDefinition' WHEN 3 THEN 'StartRuleMissing' WHEN 4 THEN 'RecursiveReference' END AS kind, CASE n_nationkey % 5 WHEN 1 THEN 'r' || n_nationkey || ' is not defined' WHEN 2 THEN 'start is defined twice' WHEN 3 THEN 'the grammar has no start' WHEN 4 THEN 'r' || n_nationkey || ' holds itself outside an element' END AS message FROM nation WHERE n_nationkey % 5 <> 0")
def schema_errors(spark, sf_dir):
    """What is wrong with each nation's schema; every fifth one is right."""
    own = F.concat(F.lit("r"), F.col("n_nationkey").cast("string"))
    fault = F.col("n_nationkey") % 5
    text = F.when(fault == 1, F.concat(F.lit("start = element a { "), own, F.lit(" }"))).when(fault == 2, F.lit("start = empty start = text")).when(fault == 3, F.concat(own, F.lit(" = empty"))).when(fault == 4, F.concat(F.lit("start = element a { "), own, F.lit(" } "), own, F.lit(" = "), own, F.lit("?"))).otherwise(F.lit("start = element a { empty }"))
    return graph.errors(catalogue.table(spark, sf_dir, "nation").select("n_nationkey", text.alias("text")), "n_nationkey").select("n_nationkey", "kind", "message")


@query("schema_patterns", _GRAPH + "SELECT n_nationkey, count(*)::BIGINT AS elements FROM reach GROUP BY n_nationkey")
def schema_patterns(spark, sf_dir):
    """How many element patterns each schema's automaton meets on a document that follows its references all the way down."""

    def met(text: str) -> list[tuple]:
        pool = Pool(compile_text(text))
        todo, seen = [pool.start], set()
        while todo:
            node = pool.nodes[p := todo.pop()]
            if p not in seen:
                seen.add(p)
                todo += node[1] if node[0] == "choice" else [pool.body(node[2])] if node[0] == "element" else []
        return [(sum(r[1] == "element" for r in pool.rows()),)]

    return graph.each(nation_schemas(spark, sf_dir), "elements int", met, "n_nationkey", "text").select("n_nationkey", F.col("elements").cast("long").alias("elements"))


@query("document_tokens", """SELECT n_nationkey, count(*)::BIGINT AS parts, max(n)::INTEGER AS last, string_agg(kind || ' ' || coalesce(ns || ':' || local, value), ' ' ORDER BY n) AS said FROM (
  SELECT n_nationkey, n, one['kind'] AS kind, one['ns'] AS ns, one['local'] AS local, one['value'] AS value FROM (SELECT n_nationkey, unnest(parts) AS one, generate_subscripts(parts, 1) - 1 AS n FROM (
    SELECT n_nationkey, list_concat([{'kind': 'element', 'ns': '', 'local': 'land', 'value': NULL::VARCHAR}, {'kind': 'attribute', 'ns': '', 'local': 'key', 'value': n_nationkey::VARCHAR}],
      CASE WHEN n_nationkey % 5 <> 0 THEN [{'kind': 'attribute', 'ns': '', 'local': 'name', 'value': n_name}] ELSE [] END,
      [{'kind': 'element', 'ns': '', 'local': 'size', 'value': NULL}, {'kind': 'text', 'ns': NULL, 'local': NULL, 'value': '1'}, {'kind': 'end', 'ns': '', 'local': 'size', 'value': NULL}],
      CASE WHEN n_nationkey % 4 = 0 THEN [{'kind': 'element', 'ns': '', 'local': 'size', 'value': NULL}, {'kind': 'text', 'ns': NULL, 'local': NULL, 'value': '2'}, {'kind': 'end', 'ns': '', 'local': 'size', 'value': NULL}] ELSE [] END,
      CASE WHEN n_nationkey % 3 = 0 THEN [{'kind': 'element', 'ns': 'urn:x', 'local': 'note', 'value': NULL}, {'kind': 'text', 'ns': NULL, 'local': NULL, 'value': 't'}, {'kind': 'end', 'ns': 'urn:x', 'local': 'note', 'value': NULL}] ELSE [] END,
      [{'kind': 'end', 'ns': '', 'local': 'land', 'value': NULL}]) AS parts FROM nation))) GROUP BY n_nationkey""")
def document_tokens(spark, sf_dir):
    """The parts of each document, counted and spelt out in order."""
    rows = tokens(nation_docs(spark, sf_dir), "n_nationkey")
    said = F.concat(F.col("kind"), F.lit(" "), F.coalesce(F.concat("ns", F.lit(":"), "local"), "value"))
    by = rows.groupBy("n_nationkey").agg(F.count("*").alias("parts"), F.max("n").alias("last"), F.array_sort(F.collect_list(F.struct("n", said.alias("s")))).alias("all"))
    return by.select("n_nationkey", "parts", "last", F.array_join(F.transform("all", lambda x: x["s"]), " ").alias("said"))


def scope_docs(spark, sf_dir) -> DataFrame:
    """Declarations that end with their element: the inner p is a region's, the outer one everyone's, and every fourth nation uses a prefix that is gone."""
    key = F.col("n_nationkey")
    inner = F.concat(F.lit('<k xmlns="urn:k" p:a="1"><p:j xmlns:p="urn:r'), F.col("n_regionkey").cast("string"), F.lit('"><p:m/></p:j><m/></k>'))
    last = F.when(key % 4 == 0, "<q:z/>").otherwise(F.lit("<p:z/>"))
    return catalogue.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit('<g xmlns:p="urn:p"><i xmlns:q="urn:q"/>'), inner, last, F.lit("</g>")).alias("xml"))


@query("ns_nearest_join", """SELECT n_nationkey, 'element :g element :i end :i element urn:k:k attribute urn:p:a element urn:r' || n_regionkey || ':j element urn:r' || n_regionkey || ':m end urn:r' || n_regionkey || ':m end urn:r' || n_regionkey || ':j '
  || 'element urn:k:m end urn:k:m end urn:k:k ' || CASE WHEN n_nationkey % 4 = 0 THEN 'element ?:z end ?:z ' ELSE 'element urn:p:z end urn:p:z ' END || 'end :g' AS said FROM nation""")
def ns_nearest_join(spark, sf_dir):
    """Every name with the namespace of the nearest enclosing declaration, by a join."""
    rows = resolved(raw_tokens(scope_docs(spark, sf_dir), "n_nationkey"), "n_nationkey")
    said = F.concat(F.col("kind"), F.lit(" "), F.coalesce("ns", F.lit("?")), F.lit(":"), "local")
    return rows.groupBy("n_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", said.alias("s")))), lambda x: x["s"]), " ").alias("said"))


@query("ns_undefined", "SELECT n_nationkey, 'q' AS prefix, 2::BIGINT AS names FROM nation WHERE n_nationkey % 4 = 0")
def ns_undefined(spark, sf_dir):
    """The names whose prefix nothing declares, by an anti-join."""
    lost = undefined(raw_tokens(scope_docs(spark, sf_dir), "n_nationkey"), "n_nationkey")
    return lost.groupBy("n_nationkey", "prefix").agg(F.count("*").alias("names"))


@query("parts_valid", ORACLES["schema_include"])
def parts_valid(spark, sf_dir):
    """Documents validated part by part, as a stream of parts would be."""
    schema = compile_schema("m.rnc", Memory({"m.rnc": "include 'base.rnc'", "base.rnc": _BASE}))
    return validate_parts(part_rows(nation_docs(spark, sf_dir), "n_nationkey"), schema, "n_nationkey").select("n_nationkey", "valid")
