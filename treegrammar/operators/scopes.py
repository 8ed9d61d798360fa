"""Namespaces by joins: the parts of documents as they are written, and their prefixes resolved from the declarations that enclose them.

A declaration holds from its element's start to its end, so the declarations that hold at a part are those of its prefix whose
interval it lies in, and the nearest one is that which began last.  Intervals are cut at every BIN parts: parts and declarations meet on
(document, prefix, bin), which also deals a large document over many tasks, and a part meets only declarations of its own bin.
Prefixes that no declaration encloses come out of an anti-join.

Defined results: the prefix xml needs no declaration; attributes without a prefix are in no namespace, elements without one in the
default namespace, which is none where nothing is declared; a prefix that is undeclared or declared as nothing is in no namespace that there is
(null); a null document has no parts; one that is not well-formed has those before the fault; repeated rows of a document number share
their numbers, so give documents keys of their own.
"""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treegrammar.plans.model import XML_NS

BIN = 4096
RAW = "n int, owner int, last int, kind string, prefix string, local string, value string"


def raw_parts(xml: str | None) -> list[tuple]:
    """The rows of RAW in document order: element, namespace (local: the declared prefix), attribute, text, end.

    owner: the number of the element that a part belongs to; last: for elements and what is in their start tags, the number of the element's end."""
    out: list[list] = []
    open_: list[int] = []
    held: list[str] = []
    parser = expat.ParserCreate()
    parser.ordered_attributes = True

    def put(kind: str, raw: str | None, value: str | None = None, owner: int | None = None) -> None:
        prefix, _, local = (raw or "").rpartition(":")
        out.append([len(out), owner if owner is not None else open_[-1] if open_ else None, None, kind, prefix if raw is not None else None, local if raw is not None else None, value])

    def flush() -> None:
        if held:
            put("text", None, "".join(held))
            held.clear()

    def start(raw: str, flat: list[str]) -> None:
        flush()
        at = len(out)
        put("element", raw, None, at)
        open_.append(at)
        for k, v in zip(flat[::2], flat[1::2]):
            if k == "xmlns" or k.startswith("xmlns:"):
                out.append([len(out), at, None, "namespace", "", k[6:], v])
            else:
                put("attribute", k, v)

    def end(raw: str) -> None:
        flush()
        put("end", raw)
        at = open_.pop()
        i = at
        while i < len(out) and out[i][1] == at and out[i][3] in ("element", "namespace", "attribute"):
            out[i][2] = len(out) - 1
            i += 1

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, held.append
    try:
        if xml is not None:
            parser.Parse(xml.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError:
        pass  # what stood before the fault
    for r in out:
        if r[2] is None and r[3] in ("element", "namespace", "attribute"):
            r[2] = len(out) - 1
    return [tuple(r) for r in out]


def raw_tokens(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """id_col and RAW: a row for each part of each document, names as they are written."""
    rows = docs.select(F.col(id_col), F.col(xml_col).cast("string").alias("xml"))
    names = [f.split()[0] for f in RAW.split(", ")]
    types = [{"int": pa.int32(), "string": pa.string()}[f.split()[1]] for f in RAW.split(", ")]

    def run(batches):
        for b in batches:
            for i, xml in enumerate(b.column(1).to_pylist()):  # a document at a time: its parts may be many
                found = raw_parts(xml)
                if found:
                    ids = pa.array([b.column(0)[i].as_py()] * len(found), b.column(0).type)
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*found), types))], names=[b.schema.names[0], *names])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {RAW}")


def declarations(raw: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, prefix, begin, last, uri): where each declared prefix holds."""
    return raw.where("kind = 'namespace'").select(id_col, F.col("local").alias("prefix"), F.col("owner").alias("begin"), "last", F.col("value").alias("uri"))


def nearest(uses: DataFrame, held: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n, prefix, uri) of every use (id_col, n, prefix) that a declaration encloses: that of the nearest one."""
    bins = held.withColumn("bin", F.explode(F.sequence(F.floor(F.col("begin") / BIN), F.floor(F.col("last") / BIN))))
    asked = uses.select(F.col(id_col).alias("_id"), "n", F.col("prefix").alias("_prefix"), F.floor(F.col("n") / BIN).alias("_bin"))
    met = asked.join(bins, F.col("_id").eqNullSafe(F.col(id_col)) & (F.col("_prefix") == F.col("prefix")) & (F.col("_bin") == F.col("bin")) & F.col("n").between(F.col("begin"), F.col("last")))
    return met.groupBy(F.col("_id").alias(id_col), "n", F.col("_prefix").alias("prefix")).agg(F.max_by("uri", "begin").alias("uri"))


def uses_of(raw: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n, prefix) of the names that need a declaration looked up."""
    named = F.col("kind").isin("element", "end") | ((F.col("kind") == "attribute") & (F.col("prefix") != ""))
    return raw.where(named & (F.col("prefix") != "xml")).select(id_col, "n", "prefix")


def undefined(raw: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n, prefix) of the names whose prefix nothing declares."""
    uses = uses_of(raw, id_col).where("prefix <> ''")
    known = nearest(uses, declarations(raw, id_col), id_col).where("uri <> ''").select(F.col(id_col).alias("_id"), F.col("n").alias("_n"))
    return uses.join(known, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("n") == F.col("_n")), "left_anti")


def resolved(raw: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """raw's rows but the declarations, with ns: the namespace of a name, null for text and for undefined prefixes."""
    found = nearest(uses_of(raw, id_col), declarations(raw, id_col), id_col).select(F.col(id_col).alias("_id"), F.col("n").alias("_n"), "uri")
    rows = raw.where("kind <> 'namespace'").join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("n") == F.col("_n")), "left")
    ns = F.when(F.col("prefix") == "xml", XML_NS).when((F.col("kind") == "attribute") & (F.col("prefix") == ""), "").when(F.col("prefix") == "", F.coalesce("uri", F.lit(""))).otherwise(F.nullif(F.col("uri"), F.lit("")))
    return rows.withColumn("ns", F.when(F.col("kind") != "text", ns)).drop("_id", "_n", "uri")
