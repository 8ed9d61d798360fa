"""Queries over node tables and arrays built from rows: the twins of document queries, without XML text and without Python, and all faults of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treegrammar.operators.fold import automaton, fold_valid
from treegrammar.operators.tree import NODE, fault_counts, faults, identity_faults, validate_tree
from treegrammar.plans import catalogue
from treegrammar.plans.catalogue import table
from treegrammar.plans.model import compile_text

QUERIES: dict[str, catalogue.Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def nodes(rows: DataFrame, doc: str, node: Column, parent: Column | None, local: Column, text: Column | None = None, pos: Column | None = None) -> DataFrame:
    """A part of a node table."""
    nothing = F.lit(None).cast("string")
    return rows.select(F.col(doc).alias("doc"), node.alias("node"), (nothing if parent is None else parent).alias("parent"), (F.lit(None).cast("int") if pos is None else pos).alias("pos"), F.lit("").alias("ns"), local.alias("local"), (nothing if text is None else text).alias("text")).select(*NODE)


def attributes(rows: DataFrame, doc: str, node: Column, **values: Column) -> DataFrame:
    """A part of an attribute table; null values are no attributes."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("local"), v.cast("string").alias("value")) for k, v in values.items()))).alias("a")
    return rows.select(F.col(doc).alias("doc"), node.alias("node"), each).select("doc", "node", F.lit("").alias("ns"), "a.local", "a.value").where("value is not null")


ROWS = 150_000  # line items of a partition, whose elements are counted in memory


def order_tree(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders with their line items as nodes and attributes; items of an order are told apart by their place in it.

    Both tables are dealt out alike by order, so that nothing that is counted by document and node is shuffled again."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = orders.count() + items.count()
    n = max(rows // ROWS, min(rows // 10_000, spark.sparkContext.defaultParallelism)) + 1
    orders, items = orders.repartition(n, "o_orderkey"), items.repartition(n, "l_orderkey")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag", "l_quantity", "l_partkey", "l_suppkey")
    items = items.select("l_orderkey", F.col("l_linenumber"), "l_returnflag", F.col("l_quantity").cast("bigint").cast("string").alias("qty"), F.row_number().over(place).alias("at"))
    root_key, key = F.lit(0).cast("long"), lambda part: F.col("at").cast("long") * 3 + part
    parts = F.explode(
        F.array(
            F.struct(key(0).alias("node"), root_key.alias("parent"), F.col("at").alias("pos"), F.lit("item").alias("local"), F.lit(None).cast("string").alias("text")),
            F.struct(key(1).alias("node"), key(0).alias("parent"), F.lit(1).alias("pos"), F.lit("flag").alias("local"), F.col("l_returnflag").alias("text")),
            F.struct(key(2).alias("node"), key(0).alias("parent"), F.lit(2).alias("pos"), F.lit("qty").alias("local"), F.col("qty").alias("text")),
        )
    ).alias("p")
    inner = items.select(F.col("l_orderkey").alias("doc"), parts).select("doc", "p.node", "p.parent", "p.pos", F.lit("").alias("ns"), "p.local", "p.text")
    root = nodes(orders, "o_orderkey", root_key, F.lit(None).cast("long"), F.lit("order"))
    return root.union(inner), attributes(orders, "o_orderkey", root_key, status=F.col("o_orderstatus")).union(attributes(items, "l_orderkey", key(0), n=F.col("l_linenumber")))


@query("tree_orders", catalogue.ORACLES["validate_order_docs"])
def tree_orders(spark, sf_dir):
    return validate_tree(*order_tree(spark, sf_dir), compile_text(catalogue.ORDER), "o_orderkey").select("o_orderkey", "valid")


@query("tree_order_faults", """SELECT o_orderkey, kind, count(*)::BIGINT AS faults FROM (
  SELECT o_orderkey, 'element-close' AS kind FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT o_orderkey, 'attribute' FROM orders WHERE o_orderstatus NOT IN ('O', 'F', 'P')
  UNION ALL SELECT l_orderkey, 'text' FROM lineitem WHERE l_returnflag NOT IN ('R', 'A', 'N')
  UNION ALL SELECT l_orderkey, 'text' FROM lineitem WHERE CAST(l_quantity AS BIGINT) NOT BETWEEN 1 AND 45) GROUP BY o_orderkey, kind""")
def tree_order_faults(spark, sf_dir):
    """All faults of every order that has any, by kind."""
    found = fault_counts(*order_tree(spark, sf_dir), compile_text(catalogue.ORDER))
    return found.withColumnRenamed("doc", "o_orderkey")


def log_tree(spark, sf_dir) -> DataFrame:
    """A user's whole log: its events below one node."""
    events = table(spark, sf_dir, "events")
    root = nodes(events.select("user_id").distinct(), "user_id", F.lit("log"), None, F.lit("log"))
    return root.union(nodes(events, "user_id", F.col("event_id").cast("string"), F.lit("log"), F.col("event_type")))


def _logs(name: str, schema: str, sql: str) -> None:
    query(name, sql)(lambda spark, sf_dir: validate_tree(log_tree(spark, sf_dir), None, compile_text(schema), "user_id").select("user_id", "valid"))


_logs("tree_events_interleave", catalogue.LOOSE_INTERLEAVE, catalogue.ORACLES["events_log_interleave_loose"])
_SOME = "(element view { empty } | element click { empty })+ & element purchase { empty }* & element signup { empty }+ & " + catalogue._up_to(13, "element error { empty }")
_logs("tree_events_counts", f"element log {{ {_SOME} }}", "SELECT user_id, bool_or(event_type IN ('view', 'click')) AND bool_or(event_type = 'signup') AND count(*) FILTER (event_type = 'error') <= 13 AND bool_and(event_type IN ('view', 'click', 'error', 'purchase', 'signup')) AS valid FROM events GROUP BY user_id")


@query("tree_conversations", catalogue.ORACLES["conv_group_plus"])
def tree_conversations(spark, sf_dir):
    """An ordered content: one regular expression over the turns of a conversation."""
    rows = table(spark, sf_dir, "conversations").withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")))
    root = nodes(rows.select("conv_id").distinct(), "conv_id", F.lit("conv"), None, F.lit("conv"))
    turns = nodes(rows, "conv_id", F.col("at").cast("string"), F.lit("conv"), F.col("role"), None, F.col("at"))
    return validate_tree(root.union(turns), None, compile_text(catalogue.CONV), "conv_id").select("conv_id", "valid")


def customer_tree(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The customers of catalogue.customer_docs: every third has no segment, every fifth an extra attribute."""
    rows, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    root = nodes(rows, "c_custkey", F.lit("c"), None, F.lit("customer"))
    return root, attributes(rows, "c_custkey", F.lit("c"), seg=F.when(key % 3 != 0, F.col("c_mktsegment")), extra=F.when(key % 5 == 0, "1"))


def _customers(name: str, schema: str, sql: str) -> None:
    query(name, f"SELECT c_custkey, {sql} AS valid FROM customer")(lambda spark, sf_dir: validate_tree(*customer_tree(spark, sf_dir), compile_text(schema), "c_custkey").select("c_custkey", "valid"))


_customers("tree_attr_required", "element customer { attribute seg { text }, attribute extra { text }? }", "c_custkey % 3 <> 0")
_customers("tree_attr_unexpected", "element customer { attribute seg { text }? }", "c_custkey % 5 <> 0")
_customers("tree_attr_any_except", "element customer { attribute * - extra { text }* }", "c_custkey % 5 <> 0")
_customers("tree_attr_any_plus", "element customer { attribute * { text }+ }", "c_custkey % 3 <> 0 OR c_custkey % 5 = 0")
_customers("tree_attr_values", 'element customer { attribute seg { "BUILDING" | "MACHINERY" }?, attribute extra { xsd:boolean }? }', "c_custkey % 3 = 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY')")


@query("tree_attr_missing", "SELECT c_custkey, 'element-open-end' AS kind, 'seg' AS local FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'attribute', 'extra' FROM customer WHERE c_custkey % 5 = 0")
def tree_attr_missing(spark, sf_dir):
    """The required attributes that are absent and the present ones that are not allowed, by name."""
    found = faults(*customer_tree(spark, sf_dir), compile_text("element customer { attribute seg { text } }"))
    return found.select(F.col("doc").alias("c_custkey"), "kind", "local")


@query("tree_recursive", catalogue.ORACLES["ref_recursive"])
def tree_recursive(spark, sf_dir):
    """Regions in nations in regions, as deep as the rows go: typed a level at a time."""
    rows = table(spark, sf_dir, "nation")
    key, level = F.col("n_nationkey"), F.explode(F.sequence(F.lit(1), (F.col("n_nationkey") % 5 + 1).cast("int"))).alias("level")
    each = rows.select("n_nationkey", level)
    name = lambda letter, shift=0: F.concat(F.lit(letter), (F.col("level") + shift).cast("string"))
    regions = nodes(each, "n_nationkey", name("r"), F.when(F.col("level") > 1, name("n", -1)), F.lit("region"))
    nations = nodes(each, "n_nationkey", name("n"), name("r"), F.lit("nation"))
    last = rows.where(key % 7 == 0).select("n_nationkey", F.concat(F.lit("n"), (key % 5 + 1).cast("string")).alias("under"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("id"))
    twice = nodes(last, "n_nationkey", F.col("id"), F.col("under"), F.lit("region"))
    keys = attributes(each, "n_nationkey", name("n"), key=key)
    return validate_tree(regions.union(nations).union(twice), keys, compile_text(catalogue.GEO), "n_nationkey").select("n_nationkey", "valid")


PEOPLE = "element land { element person { attribute id { xsd:ID }, attribute knows { xsd:IDREF }?, element boss { xsd:IDREF }? }* }"


@query("id_idref_faults", """WITH people AS (SELECT c_nationkey AS land, c_custkey, 'c' || (c_custkey % 997) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'c' || ((c_custkey * 7) % 1100) END AS knows,
    CASE WHEN c_custkey % 5 = 0 THEN 'c' || (c_custkey % 1009) END AS boss FROM customer)
  SELECT land, 'duplicate-id' AS kind, id AS value, 1::BIGINT AS faults FROM people GROUP BY land, id HAVING count(*) > 1
  UNION ALL SELECT land, 'dangling-idref', ref, count(*) FROM (SELECT land, knows AS ref FROM people WHERE knows IS NOT NULL UNION ALL SELECT land, boss FROM people WHERE boss IS NOT NULL) r
  WHERE NOT EXISTS (SELECT 1 FROM people p WHERE p.land = r.land AND p.id = r.ref) GROUP BY land, ref""")
def id_idref_faults(spark, sf_dir):
    """Customers of a nation as one document: their keys repeat, and some of their references lead nowhere."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.concat(F.lit("p"), key.cast("string")).alias("node"))
    code = lambda n: F.concat(F.lit("c"), n.cast("string"))
    root = nodes(rows.select("c_nationkey").distinct(), "c_nationkey", F.lit("land"), None, F.lit("land"))
    people = nodes(rows, "c_nationkey", F.col("node"), F.lit("land"), F.lit("person"))
    bosses = nodes(rows.where(key % 5 == 0), "c_nationkey", F.concat(F.lit("b"), "node"), F.col("node"), F.lit("boss"), F.concat(F.lit(" "), code(key % 1009)))
    values = attributes(rows, "c_nationkey", F.col("node"), id=code(key % 997), knows=F.when(key % 2 == 0, code((key * 7) % 1100)))
    found = identity_faults(root.union(people).union(bosses), values, compile_text(PEOPLE))
    return found.groupBy(F.col("doc").alias("land"), "kind", "value").agg(F.count("*").alias("faults"))


def _folds(name: str, twin: str, schema: str, root: str, rows: str, key: str, order: list[str], child: str) -> None:
    def run(spark, sf_dir):
        steps = automaton(compile_text(schema), root)
        gathered = F.transform(F.array_sort(F.collect_list(F.struct(*order, child))), lambda x: x[child])
        return table(spark, sf_dir, rows).groupBy(key).agg(gathered.alias("children")).select(key, fold_valid(F.col("children"), steps).alias("valid"))

    query(name, catalogue.ORACLES[twin])(run)


_folds("fold_conversations", "conv_group_plus", catalogue.CONV, "conv", "conversations", "conv_id", ["turn"], "role")
_folds("fold_events_choice_star", "events_log_choice_star_loose", catalogue.LOOSE_STAR, "log", "events", "user_id", ["ts", "event_id"], "event_type")
_folds("fold_events_optional", "events_log_optional_loose", catalogue.LOOSE_OPTIONAL, "log", "events", "user_id", ["ts", "event_id"], "event_type")
_folds("fold_events_interleave", "events_log_interleave_loose", catalogue.LOOSE_INTERLEAVE, "log", "events", "user_id", ["ts", "event_id"], "event_type")
