"""Document tables: XML files, and documents rendered from relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, xml): one row for each file; doc_id is its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("xml"))


def escaped(c: Column) -> Column:
    """Text as it stands in content or in a double-quoted attribute."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def rendered(rows: DataFrame, key: str, order: list[str], item: Column, tag: str, attributes: Column | None = None) -> DataFrame:
    """(key, xml): an element for each key that holds its rows' items in order; ties in order are broken by the item itself, and null items leave nothing."""
    columns = [key, F.struct(*order, item.alias("x")).alias("i")]
    one = rows.select(*columns, *([attributes.alias("a")] if attributes is not None else []))
    head = F.first("a") if attributes is not None else F.lit("")
    body = F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["x"]), "")
    return one.groupBy(key).agg(F.concat(F.lit(f"<{tag}"), head, F.lit(">"), body, F.lit(f"</{tag}>")).alias("xml"))


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, xml): every order with its line items, if it has any."""
    orders, items = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = orders.select("o_orderkey", "o_orderstatus").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    item = F.concat(F.lit('<item n="'), F.col("l_linenumber").cast("string"), F.lit('"><flag>'), escaped(F.col("l_returnflag")), F.lit("</flag><qty>"), F.col("l_quantity").cast("bigint").cast("string"), F.lit("</qty></item>"))
    return rendered(rows, "o_orderkey", ["l_linenumber"], item, "order", F.concat(F.lit(' status="'), escaped(F.col("o_orderstatus")), F.lit('"')))
