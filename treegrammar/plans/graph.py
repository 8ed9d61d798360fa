"""Tables of schemas: parsed and compiled on the executors, a row a schema, and their rules and references as a graph.

Rules are nodes and references are edges (schema, rule, target, inside: below an element).  What the start reaches, what nothing
reaches and what reaches itself follows from joins of the edges, a step at a time; a step's new rows are written in the shared folder, and
only whether there are any comes to the driver.

Defined results: a schema that is null or does not compile has no rules and one row of errors; repeated schema keys share their rules;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treegrammar.errors import SchemaError
from treegrammar.functions.datatypes import Datatype
from treegrammar.plans.model import CompiledSchema, compile_schema
from treegrammar.sources.schemas import Memory, parse
from treegrammar.sources.tables import cut, forget
from treegrammar.syntax.tree import nodes

_TYPES = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def each(schemas: DataFrame, fields: str, f: Callable[[str | None], list[tuple]], id_col: str, text_col: str) -> DataFrame:
    """id_col and fields: the rows that f gives for each schema's text."""
    rows = schemas.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    names, types = zip(*((n.strip("`"), _TYPES[t]) for n, t in (x.split() for x in fields.split(", "))))

    def run(batches):
        for b in batches:
            keys, out = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = f(text)
                keys += [key] * len(found)
                out += found
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), *(pa.array(c, t) for c, t in zip(zip(*out), types))], names=[b.schema.names[0], *names])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {fields}")


def compiled(text: str | None, files: dict[str, str] | None = None) -> CompiledSchema | SchemaError:
    """A schema of one text, or what is wrong with it. files: what it may include."""
    if text is None:
        return SchemaError("null", "no schema")
    try:
        return compile_schema("schema", Memory({**(files or {}), "schema": text}))
    except SchemaError as e:
        return e


def tree_nodes(schemas: DataFrame, id_col: str = "schema_id", text_col: str = "text") -> DataFrame:
    """(id_col, node_id, parent_id, kind, name, start, end): the syntax tree of every schema that can be read."""

    def f(text):
        try:
            return [r[1:] for r in nodes(parse(text, "schema", "auto", ""))] if text is not None else []
        except SchemaError:
            return []

    return each(schemas, "node_id int, parent_id int, kind string, name string, start int, `end` int", f, id_col, text_col)


def errors(schemas: DataFrame, id_col: str = "schema_id", text_col: str = "text", files: dict[str, str] | None = None) -> DataFrame:
    """(id_col, kind, message, file, start, end): what is wrong with every schema that does not compile."""

    def f(text):
        e = compiled(text, files)
        return [(e.kind, e.message, e.file, *e.span)] if isinstance(e, SchemaError) else []

    return each(schemas, "kind string, message string, file string, start int, `end` int", f, id_col, text_col)


def places(schemas: DataFrame, id_col: str = "schema_id", text_col: str = "text", files: dict[str, str] | None = None) -> DataFrame:
    """(id_col, n, note, file, start, end): all places of a schema's error: the error itself (n 0), what it contradicts, and the includes that led there."""

    def f(text):
        e = compiled(text, files)
        return [(n, *p) for n, p in enumerate(e.all_places())] if isinstance(e, SchemaError) else []

    return each(schemas, "n int, note string, file string, start int, `end` int", f, id_col, text_col)


def facets(schemas: DataFrame, id_col: str = "schema_id", text_col: str = "text", files: dict[str, str] | None = None) -> DataFrame:
    """(id_col, rule, nth, library, type, facet, value): what every datatype of a schema's rules demands; nth counts the datatypes of a rule.

    Facets are those given, and what follows from them and the type: min and max (the bounds that the type and the facets leave, whole numbers as
    inclusive ones), min_length and max_length.  A datatype without any has one row with nulls.
    """

    def f(text):
        c = compiled(text, files)
        if isinstance(c, SchemaError):
            return []
        out = []
        for name, p in zip(c.names, c.rules):
            for nth, d in enumerate(datatypes(p)):
                rows = [(name, nth, d.library, d.name, k, v) for k, v in (*d.facets, *d.derived())] if isinstance(d, Datatype) else []
                out += rows or [(name, nth, getattr(d, "library", None), getattr(d, "name", None), None, None)]
        return out

    return each(schemas, "rule string, nth int, library string, type string, facet string, value string", f, id_col, text_col)


def datatypes(p: tuple) -> list:
    """The datatypes of a pattern, in order."""
    own = [p[1]] if p[0] in ("data", "data_except") else []
    parts = p[1] if p[0] in ("group", "interleave", "choice") else [q for q in p[1:] if type(q) is tuple and q and isinstance(q[0], str)]
    return own + [d for q in parts for d in datatypes(q)]


def loaded(schemas: DataFrame, files: dict[str, str], id_col: str = "schema_id", text_col: str = "text") -> DataFrame:
    """(id_col, path): the files that each schema is made of, its own text left out."""
    return each(schemas, "path string", lambda text: [(p,) for p in getattr(compiled(text, files), "loaded", []) if p != "schema"], id_col, text_col)


def references(p: tuple, inside: bool = False) -> list[tuple[int, bool]]:
    """(target, below an element) of the references of a pattern."""
    if p[0] == "ref":
        return [(p[1], inside)]
    parts = p[1] if p[0] in ("group", "interleave", "choice") else [q for q in p[1:] if isinstance(q, tuple)]
    return [r for q in parts for r in references(q, inside or p[0] == "element")]


def rules(schemas: DataFrame, id_col: str = "schema_id", text_col: str = "text", files: dict[str, str] | None = None) -> DataFrame:
    """(id_col, rule, name, start): the rules of every schema."""

    def f(text):
        c = compiled(text, files)
        return [] if isinstance(c, SchemaError) else [(n, name, n == c.start) for n, name in enumerate(c.names)]

    return each(schemas, "rule int, name string, start boolean", f, id_col, text_col)


def edges(schemas: DataFrame, id_col: str = "schema_id", text_col: str = "text", files: dict[str, str] | None = None) -> DataFrame:
    """(id_col, rule, target, inside): every reference between rules."""

    def f(text):
        c = compiled(text, files)
        return [] if isinstance(c, SchemaError) else sorted({(n, t, i) for n, p in enumerate(c.rules) for t, i in references(p)})

    return each(schemas, "rule int, target int, inside boolean", f, id_col, text_col)


def grown(first: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """first and all that step leads to from it, without repeats: each round takes only what the last one found."""
    spark = first.sparkSession
    rounds = [cut(spark, first.select(*keys).distinct(), "graph")]
    while not rounds[-1].isEmpty():
        new = step(rounds[-1]).select(*keys).distinct()
        for seen in rounds:
            new = new.join(seen, keys, "left_anti")
        rounds.append(cut(spark, new, "graph"))
    all_ = cut(spark, spark_union(rounds), "graph")
    forget(*rounds)
    return all_


def spark_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def reached(of_rules: DataFrame, of_edges: DataFrame, id_col: str = "schema_id") -> DataFrame:
    """(id_col, rule): the rules that each schema's start leads to, itself included."""
    to = of_edges.select(F.col(id_col), "rule", "target")
    return grown(of_rules.where("start"), lambda last: last.join(to, [id_col, "rule"]).select(id_col, F.col("target").alias("rule")), [id_col, "rule"])


def unused(of_rules: DataFrame, of_edges: DataFrame, id_col: str = "schema_id") -> DataFrame:
    """(id_col, rule, name): definitions that nothing leads to."""
    return of_rules.join(reached(of_rules, of_edges, id_col), [id_col, "rule"], "left_anti").select(id_col, "rule", "name")


def recursive(of_rules: DataFrame, of_edges: DataFrame, id_col: str = "schema_id") -> DataFrame:
    """(id_col, rule, name): rules that lead to themselves."""
    to = of_edges.select(F.col(id_col), F.col("rule").alias("via"), F.col("target").alias("next"))
    ways = grown(of_edges, lambda last: last.join(to, (last[id_col] == to[id_col]) & (last["target"] == to["via"])).select(last[id_col], last["rule"], F.col("next").alias("target")), [id_col, "rule", "target"])
    return of_rules.join(ways.where("rule = target").select(id_col, "rule"), [id_col, "rule"], "left_semi").select(id_col, "rule", "name")
