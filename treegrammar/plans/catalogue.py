"""The engine's queries over the test tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treegrammar.functions import names as nc
from treegrammar.functions.datatypes import LEXICAL, WHOLE, XSD, compile_datatype, compile_value
from treegrammar.functions.text import entity_names, is_whitespace_column, list_items, normalize_ws
from treegrammar.operators.relational import children_valid
from treegrammar.operators.validate import validate
from treegrammar.plans.model import compile_text
from treegrammar.sources.documents import escaped, order_docs, rendered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- documents

ORDER = """element order { attribute status { "O" | "F" | "P" }, element item { attribute n { xsd:int },
  element flag { "R" | "A" | "N" }, element qty { xsd:integer { minInclusive = "1" maxInclusive = "45" } } }+ }"""
_ORDER_OK = "bool_and(CAST(l_quantity AS BIGINT) BETWEEN 1 AND 45 AND l_returnflag IN ('R', 'A', 'N')) AND max(o_orderstatus) IN ('O', 'F', 'P')"


_ORDERS = "FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"
#: An order without items ends too early; all others can only fail in a text.
_ORDER_KIND = f"CASE WHEN count(l_orderkey) = 0 THEN 'element-close' WHEN NOT ({_ORDER_OK}) THEN 'text' END"


@query("validate_order_docs", f"SELECT o_orderkey, coalesce({_ORDER_OK}, false) AS valid {_ORDERS}")
def validate_order_docs(spark, sf_dir):
    return validate(order_docs(spark, sf_dir), compile_text(ORDER), "o_orderkey").select("o_orderkey", "valid")


@query("first_error", f"SELECT o_orderkey, {_ORDER_KIND} AS error_kind, {_ORDER_KIND} || ' not expected here' AS message {_ORDERS}")
def first_error(spark, sf_dir):
    return validate(order_docs(spark, sf_dir), compile_text(ORDER), "o_orderkey").select("o_orderkey", "error_kind", "message")


CONV = "element conv { (element user { empty }, element assistant { empty })+ }"
_CONV_SQL = "SELECT conv_id, regexp_full_match(string_agg(CASE role WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role), '(ua)+') AS valid FROM conversations GROUP BY conv_id"


@query("conv_group_plus", _CONV_SQL)
def conv_group_plus(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    docs = rendered(rows, "conv_id", ["turn"], F.concat(F.lit("<"), "role", F.lit("/>")), "conv")
    return validate(docs, compile_text(CONV), "conv_id").select("conv_id", "valid")


@query("conv_group_plus_relational", _CONV_SQL)
def conv_group_plus_relational(spark, sf_dir):
    return children_valid(table(spark, sf_dir, "conversations"), compile_text(CONV), "conv_id", ["turn"], "role")


def event_docs(spark, sf_dir) -> DataFrame:
    """A user's whole log."""
    return rendered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.concat(F.lit("<"), "event_type", F.lit("/>")), "log")


def _events(name: str, schema: str, condition: str) -> None:
    query(name, f"SELECT user_id, {condition} AS valid FROM events GROUP BY user_id")(lambda spark, sf_dir: validate(event_docs(spark, sf_dir), compile_text(schema), "user_id").select("user_id", "valid"))


_ANY = "element view { empty } | element click { empty } | element purchase { empty }"
_WORD = "string_agg(CASE event_type WHEN 'signup' THEN 's' WHEN 'error' THEN 'e' ELSE 'x' END, '' ORDER BY ts, event_id)"
_events("events_choice_star", f"element log {{ ({_ANY})* }}", "bool_and(event_type IN ('view', 'click', 'purchase'))")
_events("events_optional", f"element log {{ element signup {{ empty }}?, ({_ANY} | element error {{ empty }})* }}", f"regexp_full_match({_WORD}, 's?[xe]*')")
_events("events_interleave", "element log { element error { empty }? & element signup { empty }? & element purchase { empty }? & (element view { empty } | element click { empty })* }", "count(*) FILTER (event_type = 'error') <= 1 AND count(*) FILTER (event_type = 'signup') <= 1 AND count(*) FILTER (event_type = 'purchase') <= 1")


def _up_to(n: int, item: str) -> str:
    return f"({item}, " * (n - 1) + f"{item}?" + ")?" * (n - 1)


_E, _S = "element error { empty }", "element signup { empty }"
_AT_MOST = "count(*) FILTER (event_type = 'error') <= {0} AND count(*) FILTER (event_type = 'signup') <= {0} AND count(*) FILTER (event_type = 'purchase') <= {0}"
#: The three above under their other names, and looser grammars that some logs meet.
_events("events_log_choice_star", f"element log {{ ({_ANY})* }}", "bool_and(event_type IN ('view', 'click', 'purchase'))")
_events("events_log_optional", f"element log {{ {_S}?, ({_ANY} | {_E})* }}", f"regexp_full_match({_WORD}, 's?[xe]*')")
_events("events_log_interleave", f"element log {{ {_E}? & {_S}? & element purchase {{ empty }}? & (element view {{ empty }} | element click {{ empty }})* }}", _AT_MOST.format(1))
LOOSE_INTERLEAVE = f"element log {{ {_up_to(16, _E)} & {_up_to(16, _S)} & {_up_to(16, 'element purchase { empty }')} & (element view {{ empty }} | element click {{ empty }})* }}"
LOOSE_STAR = f"element log {{ ({_E}?, {_E}?, ({_ANY} | {_S}))*, {_E}?, {_E}? }}"
LOOSE_OPTIONAL = f"element log {{ {_S}?, ({_ANY} | {_E}), ({_ANY} | {_E} | {_S})* }}"
_events("events_log_choice_star_loose", LOOSE_STAR, f"NOT contains({_WORD}, 'eee')")
_events("events_log_optional_loose", LOOSE_OPTIONAL, f"regexp_full_match({_WORD}, 's?[xe][xes]*')")
_events("events_log_interleave_loose", LOOSE_INTERLEAVE, _AT_MOST.format(16))


def customer_docs(spark, sf_dir) -> DataFrame:
    seg = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit(' seg="'), escaped(F.col("c_mktsegment")), F.lit('"'))).otherwise("")
    extra = F.when(F.col("c_custkey") % 5 == 0, ' extra="1"').otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("<customer"), seg, extra, F.lit("/>")).alias("xml"))


def _customers(name: str, schema: str, columns: str, select: tuple[str, ...]) -> None:
    query(name, f"SELECT c_custkey, {columns} FROM customer")(lambda spark, sf_dir: validate(customer_docs(spark, sf_dir), compile_text(schema), "c_custkey").select("c_custkey", *select))


_customers("attr_required", "element customer { attribute seg { text }, attribute extra { text }? }", "c_custkey % 3 <> 0 AS valid", ("valid",))
_customers("attr_unexpected", "element customer { attribute seg { text }? }", "c_custkey % 5 <> 0 AS valid, CASE WHEN c_custkey % 5 = 0 THEN 'attribute' END AS error_kind", ("valid", "error_kind"))
_customers("attr_any_except", "element customer { attribute * - extra { text }* }", "c_custkey % 5 <> 0 AS valid", ("valid",))
_customers("attr_any_plus", "element customer { attribute * { text }+ }", "c_custkey % 3 <> 0 OR c_custkey % 5 = 0 AS valid", ("valid",))
_customers("expected_names", "element customer { attribute seg { text }, attribute extra { text }? }", "CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 5 = 0 THEN 'Attribute seg' ELSE 'Attribute extra seg' END END AS expected", ("expected",))
_customers("attr_value_choice", 'element customer { attribute seg { "BUILDING" | "MACHINERY" }?, attribute extra { xsd:boolean }? }', "c_custkey % 3 = 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY') AS valid", ("valid",))

GEO = "start = region  region = element region { nation* }  nation = element nation { attribute key { xsd:int }, region? }"


@query("ref_recursive", "SELECT n_nationkey, n_nationkey % 7 <> 0 AS valid FROM nation")
def ref_recursive(spark, sf_dir):
    depth = F.col("n_nationkey") % 5 + 1
    start = F.concat(F.lit('<region><nation key="'), F.col("n_nationkey").cast("string"), F.lit('">'))
    twice = F.when(F.col("n_nationkey") % 7 == 0, "<region/><region/>").otherwise("")
    xml = F.concat(F.repeat(start, depth), twice, F.repeat(F.lit("</nation></region>"), depth))
    return validate(table(spark, sf_dir, "nation").select("n_nationkey", xml.alias("xml")), compile_text(GEO), "n_nationkey").select("n_nationkey", "valid")


@query("mixed_text", r"SELECT doc_id, doc_id % 7 <> 3 AND NOT regexp_matches(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]') AND text IS NOT NULL AND regexp_full_match(lang, '[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*') AS valid FROM documents")
def mixed_text(spark, sf_dir):
    """Every seventh document holds an element that its mixed content doesn't take."""
    last = F.when(F.col("doc_id") % 7 == 3, F.lit("<c/></doc>")).otherwise(F.lit("<b/></doc>"))
    xml = F.concat(F.lit('<doc xml:lang="'), escaped(F.col("lang")), F.lit('"><b/>'), escaped(F.col("text")), last)
    schema = compile_text("element doc { attribute xml:lang { xsd:language }, mixed { element b { empty }* } }")
    return validate(table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml")), schema).select("doc_id", "valid")


_SHORT_TEXT = "SELECT doc_id, text IS NOT NULL AND NOT regexp_matches(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]') AND coalesce(length(replace(text, chr(13) || chr(10), chr(10))) <= 1500, false) AS valid FROM documents"


@query("entities_in_text", _SHORT_TEXT)
@query("entities_in_all_text", _SHORT_TEXT)
def entities_in_text(spark, sf_dir):
    """Every row: null and ill-formed texts are not valid, CR LF is one character."""
    xml = F.concat(F.lit("<doc>"), escaped(F.col("text")), F.lit("</doc>"))
    return validate(table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml")), compile_text('element doc { xsd:string { maxLength = "1500" } }')).select("doc_id", "valid")


@query("ns_scope_lookup", "SELECT n_nationkey, n_regionkey % 2 = 0 AND n_nationkey % 3 <> 0 AS valid, CASE WHEN n_nationkey % 3 = 0 THEN 'undefined_namespace_prefix' WHEN n_regionkey % 2 <> 0 THEN 'element-start' END AS error_kind FROM nation")
def ns_scope_lookup(spark, sf_dir):
    """The prefix is declared on a closed sibling only for every third nation; the inner default namespace is the region's."""
    ns = F.concat(F.lit("urn:"), (F.col("n_regionkey") % 2).cast("string"))
    prefix = F.when(F.col("n_nationkey") % 3 == 0, F.lit('<geo xmlns="urn:g"><i xmlns:p="urn:p"/><p:j/>')).otherwise(F.lit('<geo xmlns="urn:g" xmlns:p="urn:p"><i/><p:j/>'))
    xml = F.concat(prefix, F.lit('<k xmlns="'), ns, F.lit('"/></geo>'))
    schema = compile_text('default namespace = "urn:g" namespace q = "urn:p" namespace z = "urn:0" element geo { element i { empty }, element q:j { empty }, element z:k { empty } }')
    return validate(table(spark, sf_dir, "nation").select("n_nationkey", xml.alias("xml")), schema, "n_nationkey").select("n_nationkey", "valid", "error_kind")


@query("list_in_element", "SELECT p_partkey, len(list_filter(string_split_regex(p_name || CASE WHEN p_size % 3 = 0 THEN '  ' || p_brand ELSE ' ' END, '\\s+'), lambda x: x <> '')) = 2 AS valid FROM part")
def list_in_element(spark, sf_dir):
    """Names of two words; a third of the parts have their brand as a third item."""
    more = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("  "), "p_brand")).otherwise(F.lit(" "))
    xml = F.concat(F.lit("<n>"), escaped(F.concat("p_name", more)), F.lit("</n>"))
    return validate(table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml")), compile_text("element n { list { xsd:string, xsd:string } }"), "p_partkey").select("p_partkey", "valid")


@query("data_except_in_element", "SELECT p_partkey, p_size <> 7 AND p_size <= 40 AS valid FROM part")
def data_except_in_element(spark, sf_dir):
    xml = F.concat(F.lit("<n>"), F.col("p_size").cast("string"), F.lit("</n>"))
    return validate(table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml")), compile_text('element n { xsd:int { maxInclusive = "40" } - "7" }'), "p_partkey").select("p_partkey", "valid")


# ---------------------------------------------------------------- name classes

_NAMES = "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'urn:' || CAST(n_regionkey AS STRING) END AS ns, n_name AS local FROM nation"


def names(spark, sf_dir) -> DataFrame:
    ns = F.when(F.col("n_regionkey") > 1, F.concat(F.lit("urn:"), F.col("n_regionkey").cast("string"))).when(F.col("n_regionkey") == 1, "")
    return table(spark, sf_dir, "nation").select("n_nationkey", ns.alias("ns"), F.col("n_name").alias("local"))


def _name_class(name: str, cls, sql: str) -> None:
    query(name, f"SELECT n_nationkey, {sql} AS inside FROM ({_NAMES})")(lambda spark, sf_dir: names(spark, sf_dir).select("n_nationkey", cls.column(F.col("ns"), F.col("local")).alias("inside")))


_A, _N = nc.Named("", "NATION_0"), nc.NsName("urn:2")
_name_class("nc_named", _A, "coalesce(ns, '') = '' AND local = 'NATION_0'")
_name_class("nc_nsname", _N, "coalesce(ns, '') = 'urn:2'")
_name_class("nc_any", nc.AnyName(), "true")
_name_class("nc_alt", nc.Either(_A, _N), "(coalesce(ns, '') = '' AND local = 'NATION_0') OR coalesce(ns, '') = 'urn:2'")
_name_class("nc_any_except", nc.AnyName(nc.Either(nc.NsName(""), _N)), "NOT (coalesce(ns, '') = '' OR coalesce(ns, '') = 'urn:2')")
_name_class("nc_nsname_except", nc.NsName("urn:3", nc.Named("urn:3", "NATION_8")), "coalesce(ns, '') = 'urn:3' AND NOT local = 'NATION_8'")

# ---------------------------------------------------------------- datatypes

NUMBERS = """CASE p_partkey % 13 WHEN 0 THEN CAST(p_partkey * 7919 AS STRING) WHEN 1 THEN '-' || CAST(p_partkey AS STRING) WHEN 2 THEN '+' || CAST(p_partkey AS STRING)
  WHEN 3 THEN p_brand WHEN 4 THEN ' 12' WHEN 5 THEN CAST(p_partkey AS STRING) || '.5' WHEN 6 THEN repeat('9', CAST(p_partkey % 45 AS INT)) WHEN 7 THEN '' WHEN 8 THEN '000' || CAST(p_partkey AS STRING) || '0000000'
  WHEN 9 THEN '-0' WHEN 10 THEN CAST(p_size AS STRING) WHEN 11 THEN CAST(p_size AS STRING) || 'e' || CAST(p_size % 5 AS STRING) WHEN 12 THEN CASE p_size % 7 WHEN 0 THEN 'INF' WHEN 1 THEN '.5' WHEN 2 THEN '1d' WHEN 3 THEN 'inf' WHEN 4 THEN 'NaN' WHEN 5 THEN ' -1.5E3 ' ELSE '-INF' END END"""
WORDS = """CASE p_partkey % 20 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type WHEN 3 THEN 'en-GB' WHEN 4 THEN '2024-' || lpad(CAST(p_size % 14 AS STRING), 2, '0') || '-' || lpad(CAST(p_partkey % 33 AS STRING), 2, '0')
  WHEN 5 THEN '2024-02-10T10:00:' || lpad(CAST(p_partkey % 60 AS STRING), 2, '0') || 'Z' WHEN 6 THEN 'P' || CAST(p_size AS STRING) || 'Y' WHEN 7 THEN 'true' WHEN 8 THEN 'http://x.org/' || CAST(p_partkey AS STRING) || '?q=1#f' WHEN 9 THEN ' a  b '
  WHEN 10 THEN '1' WHEN 11 THEN 'a:b' WHEN 12 THEN 'PT' WHEN 13 THEN 'P1DT2H3.5S' WHEN 14 THEN 'été_' || CAST(p_size AS STRING) WHEN 15 THEN '' WHEN 16 THEN '2024-2-3'
  WHEN 17 THEN '2023-' || lpad(CAST(p_size % 14 AS STRING), 2, '0') || '-28T' || lpad(CAST(p_partkey % 26 AS STRING), 2, '0') || ':' || lpad(CAST(p_size % 62 AS STRING), 2, '0') || ':00' || CASE WHEN p_size % 2 = 0 THEN 'Z' ELSE '+1' || CAST(p_size % 6 AS STRING) || ':00' END
  WHEN 18 THEN CAST(1899 + p_size AS STRING) || '-02-' || CAST(27 + p_size % 4 AS STRING) || CASE WHEN p_size % 3 = 0 THEN 'Z' WHEN p_size % 3 = 1 THEN '-05:00' ELSE '' END WHEN 19 THEN CASE p_size % 4 WHEN 0 THEN ' true' WHEN 1 THEN ' 2024-01-05 ' WHEN 2 THEN ' P1Y' ELSE ' été ' END END"""


def values(spark, sf_dir, expression: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(expression).alias("v"))


def _datatype(name: str, type_: str, facets: list[tuple[str, str]], sql: str, source: str) -> None:
    d = compile_datatype(XSD, type_, facets)
    query(name, f"SELECT p_partkey, v, coalesce({sql}, false) AS valid FROM (SELECT p_partkey, {source} AS v FROM part)")(lambda spark, sf_dir: values(spark, sf_dir, source).select("p_partkey", "v", d.column(F.col("v")).alias("valid")))


def _match(pattern: str, v: str = "v") -> str:
    return f"regexp_full_match({v}, {quoted(pattern)})"


#: What SQL says is written from the types' definitions, not from the checks' patterns: blanks are collapsed first in all types but string.
_COLLAPSED = "trim(regexp_replace(v, '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ')"
_BIG = f"try_cast({_COLLAPSED} AS HUGEINT)"
_INTEGER, _NATURAL = _match("[-+]?[0-9]+", _COLLAPSED), _match("[+]?[0-9]+", _COLLAPSED)
_RANGES = {"short": "BETWEEN -32768 AND 32767", "unsignedShort": "BETWEEN 0 AND 65535", "int": "BETWEEN -2147483648 AND 2147483647", "unsignedInt": "BETWEEN 0 AND 4294967295", "long": "BETWEEN -9223372036854775808 AND 9223372036854775807", "unsignedLong": "BETWEEN 0 AND 18446744073709551615"}
for _name, _range in _RANGES.items():
    _datatype(f"dt_{_name}", _name, [], f"{_NATURAL if 'unsigned' in _name else _INTEGER} AND {_BIG} {_range}", NUMBERS)
_datatype("dt_integer", "integer", [], _INTEGER, NUMBERS)
_datatype("dt_positiveInteger", "positiveInteger", [], f"{_NATURAL} AND replace(replace({_COLLAPSED}, '+', ''), '0', '') <> ''", NUMBERS)
_DECIMAL = f"({_match('[-+]?[0-9]+', _COLLAPSED)} OR {_match('[-+]?[0-9]*[.][0-9]+', _COLLAPSED)} OR {_match('[-+]?[0-9]+[.]', _COLLAPSED)})"
_datatype("dt_decimal", "decimal", [], _DECIMAL, NUMBERS)
_MANTISSA = f"regexp_replace({_COLLAPSED}, '[eE][-+]?[0-9]+$', '')"
_DOUBLE = f"({_COLLAPSED} IN ('INF', '-INF', 'NaN') OR {_DECIMAL.replace(_COLLAPSED, _MANTISSA)})"
_datatype("dt_double", "double", [], _DOUBLE, NUMBERS)
_NAME = f"{_match('[^ ]+', _COLLAPSED)} AND NOT regexp_matches({_COLLAPSED}, '[^0-9A-Za-z_é.-]')"
_datatype("dt_language", "language", [], f"len(list_filter(string_split({_COLLAPSED}, '-'), lambda x: NOT regexp_full_match(x, '[a-zA-Z0-9]{{1,8}}'))) = 0 AND {_match('[a-zA-Z]+', f'split_part({_COLLAPSED}, chr(45), 1)')}", WORDS)
_datatype("dt_boolean", "boolean", [], f"{_COLLAPSED} IN ('true', 'false', '1', '0')", WORDS)
_datatype("dt_anyURI", "anyURI", [], f"NOT contains({_COLLAPSED}, ' ') AND NOT contains({_COLLAPSED}, 'é') AND NOT (contains({_COLLAPSED}, '#') AND NOT starts_with({_COLLAPSED}, 'http'))", WORDS.replace("THEN p_brand", "THEN replace(p_brand, '#', ' ')"))
for _name in ("NCName", "ID", "IDREF"):
    _datatype(f"dt_{_name}", _name, [], f"{_NAME} AND NOT regexp_matches({_COLLAPSED}, '^[-.0-9]')", WORDS)
_TOKEN = "({0} <> '' AND NOT regexp_matches({0}, '[^0-9A-Za-z_é.:-]'))".format(_COLLAPSED)
_datatype("dt_NMTOKEN", "NMTOKEN", [], _TOKEN, WORDS)
_datatype("dt_NMTOKENS", "NMTOKENS", [("maxLength", "1")], _TOKEN, WORDS)
_DAY, _REST = f"regexp_extract({_COLLAPSED}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')", f"regexp_replace({_COLLAPSED}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', '')"
_ZONE = "({0} IN ('', 'Z') OR regexp_full_match({0}, '[-+][0-9]{{2}}:[0-5][0-9]') AND try_cast(replace(substr({0}, 2), ':', '') AS INT) <= 1400)"
_datatype("dt_date", "date", [], f"{_DAY} <> '' AND try_cast({_DAY} AS DATE) IS NOT NULL AND {_ZONE.format(_REST)}", WORDS)
_CLOCK, _AFTER = f"substr({_REST}, 2, 8)", f"substr({_REST}, 10)"
_datatype("dt_dateTime", "dateTime", [], f"{_DAY} <> '' AND try_cast({_DAY} AS DATE) IS NOT NULL AND {_REST}[1] = 'T' AND regexp_full_match({_CLOCK}, '[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') AND (try_cast({_CLOCK} AS TIME) IS NOT NULL AND {_CLOCK} < '24' OR {_CLOCK} = '24:00:00') AND {_ZONE.format(_AFTER)}", WORDS)
_datatype("dt_duration", "duration", [], f"{_match('-?P([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T([0-9]+H)?([0-9]+M)?([0-9]+([.][0-9]+)?S)?)?', _COLLAPSED)} AND NOT regexp_matches({_COLLAPSED}, '[PT]$')", WORDS)
_datatype("dt_string", "string", [], "v IS NOT NULL", WORDS.replace("WHEN 15 THEN ''", "WHEN 15 THEN NULL"))
_datatype("dt_normalizedString", "normalizedString", [("maxLength", "4")], f"length({_COLLAPSED}) <= 4", WORDS)
_datatype("dt_token", "token", [("minLength", "3"), ("pattern", "[a-z]+( [a-z]+)*")], f"length({_COLLAPSED}) >= 3 AND regexp_full_match({_COLLAPSED}, '[a-z]+( [a-z]+)*')", WORDS)
_datatype("facet_length", "string", [("length", "5")], "length(v) = 5", WORDS)
_datatype("facet_min_max_length", "string", [("minLength", "3"), ("maxLength", "9")], "length(v) BETWEEN 3 AND 9", WORDS)
_datatype("facet_pattern", "string", [("pattern", "Brand#[0-9]+")], "regexp_full_match(v, 'Brand#[0-9]+')", WORDS)
_datatype("facet_minmax", "long", [("minInclusive", "-20"), ("maxExclusive", "5000")], f"{_INTEGER} AND {_BIG} >= -20 AND {_BIG} < 5000", NUMBERS)
_datatype("facet_exclusive", "integer", [("minExclusive", "-3"), ("maxInclusive", "15838")], f"{_INTEGER} AND {_BIG} > -3 AND {_BIG} <= 15838", NUMBERS)
_datatype("facet_digits", "decimal", [("totalDigits", "4"), ("fractionDigits", "0")], f"{_match('[-+]?0*[0-9]{0,4}([.]0*)?', _COLLAPSED)} AND {_DECIMAL}", NUMBERS)
_LESS = f"try_cast({_COLLAPSED} AS DECIMAL(38, 4))"
_datatype("facet_decimal_bounds", "decimal", [("minExclusive", "-3.5"), ("maxInclusive", "15838.5")], f"{_DECIMAL} AND {_LESS} > -3.5 AND {_LESS} <= 15838.5", NUMBERS)
_datatype("facet_two_patterns", "string", [("pattern", "Brand#[0-9]+"), ("pattern", ".*[135]")], "regexp_full_match(v, 'Brand#[0-9]*[135]')", WORDS)
_datatype("facet_double_bounds", "double", [("minInclusive", "1"), ("maxInclusive", "30000")], f"{_DOUBLE} AND {_COLLAPSED} NOT IN ('INF', '-INF', 'NaN') AND try_cast({_COLLAPSED} AS DOUBLE) BETWEEN 1 AND 30000", NUMBERS)


@query("facet_max_length_text", "SELECT doc_id, coalesce(length(text) <= 1000, false) AS valid FROM documents")
def facet_max_length_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", compile_datatype(XSD, "string", [("maxLength", "1000")]).column(F.col("text")).alias("valid"))


def _value(name: str, library: str, type_: str, sql: str) -> None:
    v = compile_value(library, type_, " BUILDING ")


    def run(spark, sf_dir):
        padded = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit(" ")).otherwise(""), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, F.lit("\t ")).otherwise(" "))
        return table(spark, sf_dir, "customer").select("c_custkey", v.column(padded).alias("valid"))

    text = "CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN chr(9) || ' ' ELSE ' ' END"
    query(name, f"SELECT c_custkey, {sql.format(text)} AS valid FROM customer")(run)


_value("value_token", "", "token", "trim(regexp_replace({0}, '[ \\t]+', ' ', 'g'), ' ') = 'BUILDING'")
_value("value_string", "", "string", "({0}) = ' BUILDING '")
_value("value_xsd_token", XSD, "token", "trim(regexp_replace({0}, '[ \\t]+', ' ', 'g'), ' ') = 'BUILDING'")


def _typed(name: str, type_: str, value: str, sql: str, source: str) -> None:
    v = compile_value(XSD, type_, value)
    query(name, f"SELECT p_partkey, v, coalesce({sql}, false) AS same FROM (SELECT p_partkey, {source} AS v FROM part)")(lambda spark, sf_dir: values(spark, sf_dir, source).select("p_partkey", "v", v.column(F.col("v")).alias("same")))


_typed("value_int", "int", "+012", f"{_INTEGER} AND {_BIG} = 12", NUMBERS)
_typed("value_decimal", "decimal", "5.50", f"{_DECIMAL} AND {_LESS} = 5.5", NUMBERS)
_typed("value_boolean", "boolean", "1", f"{_COLLAPSED} IN ('1', 'true')", WORDS)
_typed("value_xsd_string", "string", "true", "v = 'true'", WORDS)


@query("data_except", "SELECT p_partkey, p_size <> 7 AS valid FROM part")
def data_except(spark, sf_dir):
    v = F.col("p_size").cast("string")
    valid = compile_datatype(XSD, "int", []).column(v) & ~compile_value("", "token", "7").column(v)
    return table(spark, sf_dir, "part").select("p_partkey", valid.alias("valid"))


# ---------------------------------------------------------------- text functions


@query("normalize_ws", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ') AS text FROM documents")
def normalize_ws_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalize_ws(F.col("text")).alias("text"))


@query("is_whitespace", f"SELECT p_partkey, regexp_full_match({WORDS}, '[ \\t\\r\\n]*') AS blank FROM part")
def is_whitespace_query(spark, sf_dir):
    return values(spark, sf_dir, WORDS).select("p_partkey", is_whitespace_column(F.col("v")).alias("blank"))


@query("entities_count", "SELECT page_id, CAST(len(regexp_extract_all(html, '&([^;&<]+);', 1)) AS INTEGER) AS entities FROM pages")
def entities_count(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(entity_names(F.col("html"))).alias("entities"))


@query("list_tokens", "SELECT p_partkey, CAST(len(list_filter(string_split_regex(p_name, '\\s+'), lambda x: x <> '')) AS INTEGER) AS items FROM part")
def list_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.size(list_items(F.col("p_name"))).alias("items"))


def datatype_twins(column: Column) -> dict[str, Column]:  # for profiling: validity of one column under every plain type
    """name -> validity column of each datatype without facets."""
    plain = [*WHOLE, "decimal", "double", *LEXICAL, "string", "token", "normalizedString", "ID", "IDREF"]
    return {n: compile_datatype(XSD, n, []).column(column) for n in plain}
