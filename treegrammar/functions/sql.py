"""Schemas in Spark SQL: a validity function and a table function of a document's parts."""

from __future__ import annotations

from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treegrammar.operators.validate import pool_of, validate_text
from treegrammar.plans.model import XML_NS, CompiledSchema

PARTS = "n int, depth int, kind string, ns string, local string, value string, line int, col int"


def register_valid(spark: SparkSession, schema: CompiledSchema, name: str = "rng_valid") -> None:
    """name(xml): is the document valid? False for null, as in validate()."""
    data = cloudpickle.dumps(schema)

    @F.pandas_udf("boolean")
    def valid(xml: pd.Series) -> pd.Series:
        found = []
        for x in xml:
            if (pool := pool_of(name, data)).worn():
                pool_of.cache_clear()
                pool = pool_of(name, data)
            found.append(validate_text(pool, x)[0])
        return pd.Series(found, dtype=bool)

    spark.udf.register(name, valid)


EXTERNAL = "entity outside the document"


class Outside(Exception):
    """An entity is declared that stands elsewhere."""


def parts(xml: str | None) -> list[tuple]:
    """The rows of PARTS, in document order: element, attribute, text, end, and as the last one error if the document is not well-formed or declares an external entity.

    Names have their namespaces; an undeclared prefix leaves ns null.  Text is joined across CDATA sections and comments.
    """
    out: list[tuple] = []
    scopes: list[dict[str, str]] = [{"xml": XML_NS, "": ""}]
    held: list[str] = []
    place = (1, 1)
    parser = expat.ParserCreate()
    parser.ordered_attributes = True

    def put(kind: str, raw: str | None, value: str | None, at: tuple[int, int], attribute: bool = False) -> None:
        prefix, _, local = (raw or "").rpartition(":")
        ns = None if raw is None else "" if attribute and not prefix else scopes[-1].get(prefix)
        out.append((len(out), len(scopes) - 1, kind, ns, local if raw is not None else None, value, *at))

    def here() -> tuple[int, int]:
        return parser.CurrentLineNumber, parser.CurrentColumnNumber + 1

    def flush() -> None:
        if held:
            put("text", None, "".join(held), place)
            held.clear()

    def text(s: str) -> None:
        nonlocal place
        if not held:
            place = here()
        held.append(s)

    def start(raw: str, flat: list[str]) -> None:
        flush()
        pairs = list(zip(flat[::2], flat[1::2]))
        scopes.append(scopes[-1] | {k[6:]: v for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")})
        put("element", raw, None, here())
        for k, v in pairs:
            if k != "xmlns" and not k.startswith("xmlns:"):
                put("attribute", k, v, here(), True)

    def end(raw: str) -> None:
        flush()
        put("end", raw, None, here())
        scopes.pop()

    def declared(name: str, parameter: bool, value: str | None, *where: str | None) -> None:
        if value is None:
            raise Outside

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.EntityDeclHandler = start, end, text, declared
    try:
        if xml is not None:
            parser.Parse(xml.encode("utf-8", "surrogatepass"), True)
    except Outside:
        out.append((len(out), len(scopes) - 1, "error", None, None, EXTERNAL, *here()))
    except expat.ExpatError as e:
        held.clear()
        out.append((len(out), len(scopes) - 1, "error", None, None, expat.ErrorString(e.code), e.lineno, e.offset + 1))
    return out


def tokens(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """id_col and PARTS: a row for each part of each document; a null document has none."""
    rows = docs.select(F.col(id_col), F.col(xml_col).cast("string").alias("xml"))
    names = [f.split()[0] for f in PARTS.split(", ")]
    kinds = {"int": pa.int32(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in PARTS.split(", ")]

    def run(batches):
        for b in batches:
            for i, xml in enumerate(b.column(1).to_pylist()):  # a document at a time: its parts may be many
                found = parts(xml)
                if found:
                    ids = pa.array([b.column(0)[i].as_py()] * len(found), b.column(0).type)
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*found), types))], names=[b.schema.names[0], *names])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {PARTS}")


def register_tokens(spark: SparkSession, name: str = "rng_tokens") -> None:
    """name(xml), a table function: the rows of PARTS of one document, for LATERAL joins."""

    class Parts:
        def eval(self, xml: str):
            yield from parts(xml)

    spark.udtf.register(name, F.udtf(Parts, returnType=PARTS))
