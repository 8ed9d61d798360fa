"""Validation of document tables: one result row for each document.

The schema is compiled on the driver and sent once; each worker keeps one pattern pool for it, so the automaton is shared by
all documents a worker sees.  Nothing is shuffled: documents are validated where they are read.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass
from functools import lru_cache
from xml.parsers import expat

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treegrammar.functions.text import is_whitespace
from treegrammar.operators.plain import Plain
from treegrammar.operators.pool import Pool
from treegrammar.plans.model import XML_NS, CompiledSchema

FIELDS = "valid boolean, error_kind string, message string, start long, line int, col int, expected string, element string, attributes array<string>"
_SCHEMA = pa.schema([("valid", pa.bool_()), ("error_kind", pa.string()), ("message", pa.string()), ("start", pa.int64()), ("line", pa.int32()), ("col", pa.int32()), ("expected", pa.string()), ("element", pa.string()), ("attributes", pa.list_(pa.string()))])
_UNDEFINED_ENTITY = expat.errors.codes[expat.errors.XML_ERROR_UNDEFINED_ENTITY]


@dataclass
class Failure(Exception):
    kind: str
    message: str
    start: int = 0
    line: int = 1
    col: int = 1
    expected: str = ""


class Run:
    """One document's way through the automaton."""

    def __init__(self, pool: Pool):
        self.pool, self.state = pool, pool.start
        self.scopes: list[dict[str, str]] = [{"xml": XML_NS, "": ""}]
        self.text: list[str] = []
        self.leaf = False  # has the open element had no child yet
        self.path: list[tuple[str, list[str]]] = []  # open elements with their attributes, as they are written
        self.parser = expat.ParserCreate()
        self.parser.ordered_attributes = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.open, self.close, self.text.append
        self.parser.EntityDeclHandler = self.declared

    def declared(self, name: str, parameter: bool, value: str | None, *where: str | None) -> None:
        """An entity that stands elsewhere is never fetched, so its declaration is an error."""
        if value is None:
            self.fail("external_entity", f"entity {name} stands outside the document")

    def fail(self, kind: str, message: str, shift: int = 0, state: int | None = None):
        p = self.parser
        raise Failure(kind, message, p.CurrentByteIndex + shift, p.CurrentLineNumber, p.CurrentColumnNumber + 1 + shift, "" if state is None else self.pool.expected(state))

    def name(self, raw: str, attribute: bool) -> tuple[str, str]:
        prefix, _, local = raw.rpartition(":")
        if not prefix:
            return ("" if attribute else self.scopes[-1][""]), local
        ns = self.scopes[-1].get(prefix)
        if not ns:
            self.fail("undefined_namespace_prefix", f"prefix {prefix} is not declared")
        return ns, local

    def take_text(self) -> None:
        """Text between child elements: blanks alone don't count."""
        s = "".join(self.text)
        self.text.clear()
        if not is_whitespace(s):
            before, self.state = self.state, self.pool.text(self.state, s)
            if self.state == self.pool.NONE:
                self.fail("text", "text not expected here", 0, before)

    def open(self, raw: str, flat: list[str]) -> None:
        self.take_text()
        pairs = list(zip(flat[::2], flat[1::2]))
        if any(k == "xmlns" or k.startswith("xmlns:") for k, _ in pairs):
            scope = dict(self.scopes[-1])
            scope.update((k[6:], v) for k, v in pairs if k == "xmlns" or k.startswith("xmlns:"))
            self.scopes.append(scope)
        else:
            self.scopes.append(self.scopes[-1])
        pool = self.pool
        self.path.append((raw, [k for k, _ in pairs]))
        ns, local = self.name(raw, False)
        before, self.state = self.state, pool.open(self.state, ns, local)
        if self.state == pool.NONE:
            self.fail("element-start", "element-start not expected here", 1, before)
        for key, value in pairs:
            if key == "xmlns" or key.startswith("xmlns:"):
                continue
            ns, local = self.name(key, True)
            before, self.state = self.state, pool.att(self.state, ns, local, value)
            if self.state == pool.NONE:
                self.fail("attribute", f"attribute {key} not expected here", 0, before)
        before, self.state = self.state, pool.close(self.state)
        if self.state == pool.NONE:
            self.fail("element-open-end", "element-open-end not expected here", 0, before)
        self.leaf = True

    def close(self, _raw: str) -> None:
        pool = self.pool
        if self.leaf:
            s = "".join(self.text)
            self.text.clear()
            before, self.state = self.state, pool.leaf(self.state, s)
            if self.state == pool.NONE:
                self.fail("text", "text not expected here", 0, before)
            self.leaf = False
        else:
            self.take_text()
        before, self.state = self.state, pool.end(self.state)
        if self.state == pool.NONE:
            self.fail("element-close", "element-close not expected here", 0, before)
        self.scopes.pop()
        self.path.pop()

    def all(self, xml: str) -> None:
        try:
            self.parser.Parse(xml.encode("utf-8", "surrogatepass"), True)
        except expat.ExpatError as e:
            kind, what = ("undefined_entity", "undefined entity") if e.code == _UNDEFINED_ENTITY else ("xml", expat.ErrorString(e.code))
            raise Failure(kind, what, self.parser.ErrorByteIndex, e.lineno, e.offset + 1) from None
        if not self.pool.nullable[self.state]:
            self.fail("document-end", "the document ends too early", 0, self.state)


class Recovering(Run):
    """A run that goes on after an error.

    An element that can't stand here is passed over with all it holds; an attribute or a text that can't is passed over (an
    attribute with a wrong value is taken as a right one); missing attributes are taken as present, and an element that ends too early as whole.  What is not well-formed ends the run.
    """

    def __init__(self, pool: Pool):
        super().__init__(pool)
        self.found: list[tuple] = []
        self.passed = 0  # open elements of one that is passed over
        self.excused = False  # the open element's text was reported

    def fail(self, kind: str, message: str, shift: int = 0, state: int | None = None):
        try:
            super().fail(kind, message, shift, state)
        except Failure as e:
            self.report(e)

    def report(self, e: Failure) -> None:
        self.found.append((len(self.found), e.kind, e.message, e.start, e.line, e.col, e.expected, *(self.path[-1] if self.path else (None, None))))

    def name(self, raw: str, attribute: bool) -> tuple[str | None, str]:
        prefix = raw.rpartition(":")[0]
        if prefix and not self.scopes[-1].get(prefix):
            self.fail("undefined_namespace_prefix", f"prefix {prefix} is not declared")
            return None, raw
        return super().name(raw, attribute)

    def take_text(self) -> None:
        before = self.state
        super().take_text()
        if self.state == self.pool.NONE:
            self.state = before

    def open(self, raw: str, flat: list[str]) -> None:
        if self.passed:
            self.passed += 1
            return
        self.take_text()
        self.leaf = False
        pairs = list(zip(flat[::2], flat[1::2]))
        self.scopes.append(self.scopes[-1] | {k[6:]: v for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")})
        pool = self.pool
        self.path.append((raw, [k for k, _ in pairs]))
        ns, local = self.name(raw, False)
        after = pool.NONE if ns is None else pool.open(self.state, ns, local)
        if after == pool.NONE:
            if ns is not None:
                self.fail("element-start", "element-start not expected here", 1, self.state)
            self.passed = 1
            return
        self.state = after
        for key, value in pairs:
            if key == "xmlns" or key.startswith("xmlns:"):
                continue
            ns, local = self.name(key, True)
            if ns is None:
                continue
            after = pool.att(self.state, ns, local, value)
            if after == pool.NONE:
                self.fail("attribute", f"attribute {key} not expected here", 0, self.state)
                after = pool.att(self.state, ns, local, None)
            self.state = self.state if after == pool.NONE else after
        after = pool.close(self.state)
        if after == pool.NONE:
            self.fail("element-open-end", "element-open-end not expected here", 0, self.state)
            after = pool.close(pool.excuse(self.state))
        self.state = after
        self.leaf, self.excused = True, False

    def close(self, _raw: str) -> None:
        pool = self.pool
        if self.passed:
            self.passed -= 1
            if not self.passed:
                self.text.clear()
                self.scopes.pop()
                self.path.pop()
            return
        if self.leaf:
            s = "".join(self.text)
            self.text.clear()
            after = pool.leaf(self.state, s)
            self.leaf = False
            if after == pool.NONE:
                self.fail("text", "text not expected here", 0, self.state)
                self.excused = True
            else:
                self.state = after
        else:
            self.take_text()
        after = pool.end(self.state)
        if after == pool.NONE:
            if not self.excused:
                self.fail("element-close", "element-close not expected here", 0, self.state)
            after = pool.leave(self.state)
        self.state, self.excused = after, False
        self.scopes.pop()
        self.path.pop()

    def all(self, xml: str) -> None:
        try:
            self.parser.Parse(xml.encode("utf-8", "surrogatepass"), True)
        except expat.ExpatError as e:
            kind, what = ("undefined_entity", "undefined entity") if e.code == _UNDEFINED_ENTITY else ("xml", expat.ErrorString(e.code))
            self.report(Failure(kind, what, self.parser.ErrorByteIndex, e.lineno, e.offset + 1))
            return
        if not self.found and not self.pool.nullable[self.state]:
            self.fail("document-end", "the document ends too early", 0, self.state)


_VALID = (True, *[None] * 8)
ERRORS = FIELDS.replace("valid boolean", "n int")
_ROWS = 10_000  # errors in a batch, and those of its last document
_ERRORS = pa.schema([("n", pa.int32()), *list(_SCHEMA)[1:]])


def errors_of(pool: Pool, xml: str | None) -> list[tuple]:
    """One document's errors in document order: ERRORS."""
    if xml is None:
        return [(0, "null", "no document", *[None] * 6)]
    found = plain(pool, Recovering, xml)
    if found is not None:
        return found
    run = Recovering(pool)
    pool.resolve = (lambda prefix: run.scopes[-1].get(prefix)) if uses_qnames(pool) else None
    run.all(xml)
    return run.found


def all_errors(docs: DataFrame, schema: CompiledSchema, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """id_col and ERRORS: a row for each error of each document, the first of which (n = 0) is validate()'s; valid documents have none."""
    data = cloudpickle.dumps(schema)
    digest = hashlib.sha256(data).hexdigest()
    rows = docs.select(id_col, F.col(xml_col).cast("string").alias("_xml"))

    id_name = rows.schema[0].name

    def batch(ids: pa.Array, at: list[int], found: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(list(c), f.type) for c, f in zip(zip(*found), _ERRORS)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), *arrays], schema=pa.schema([pa.field(id_name, ids.type), *_ERRORS]))

    def run(batches):
        for b in batches:
            pool = pool_of(digest, data)
            at, found = [], []
            for k, xml in enumerate(b.column(1).to_pylist()):
                if pool.worn():
                    pool_of.cache_clear()
                    pool = pool_of(digest, data)
                some = errors_of(pool, xml)
                at += [k] * len(some)
                found += some
                if len(found) > _ROWS:
                    yield batch(b.column(0), at, found)
                    at, found = [], []
            if found:
                yield batch(b.column(0), at, found)

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {ERRORS}")


def validate_text(pool: Pool, xml: str | None) -> tuple:
    """One document's result: FIELDS. element and attributes are those that were open at the error. A null document is invalid with kind null."""
    if xml is None:
        return (False, "null", "no document", *[None] * 6)
    found = plain(pool, Run, xml)
    if found is not None:
        return (False, *found[0][1:]) if found else _VALID
    run = Run(pool)
    pool.resolve = (lambda prefix: run.scopes[-1].get(prefix)) if uses_qnames(pool) else None
    try:
        run.all(xml)
    except Failure as e:
        return (False, e.kind, e.message, e.start, e.line, e.col, e.expected, *(run.path[-1] if run.path else (None, None)))
    return _VALID


def plain(pool: Pool, kind: type[Run], xml: str) -> list[tuple] | None:
    """The errors of a document of plain markup; None if expat has to read it."""
    if uses_qnames(pool):
        return None
    if kind not in pool.plain:
        pool.plain[kind] = Plain(kind(pool), Failure)
    return pool.plain[kind].found(xml)


def uses_qnames(pool: Pool) -> bool:
    if not hasattr(pool, "qnames"):
        pool.qnames = any(holds_qname(p) for p in pool.schema.rules)
    return pool.qnames


def holds_qname(p) -> bool:
    """Is there a value of type QName in the pattern?"""
    if not isinstance(p, tuple):
        return getattr(p, "name", "") == "QName" and hasattr(p, "value")
    return any(map(holds_qname, p))


@lru_cache(8)
def pool_of(digest: str, data: bytes) -> Pool:
    """One pool for each schema and worker."""
    return Pool(pickle.loads(data))


def validate(docs: DataFrame, schema: CompiledSchema, id_col: str = "doc_id", xml_col: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns of keep, and the result of each document. Works on streams as on tables."""
    data = cloudpickle.dumps(schema)  # types of a user's library may be anything
    digest = hashlib.sha256(data).hexdigest()
    rows = docs.select(id_col, *keep, F.col(xml_col).cast("string").alias("_xml"))
    out = rows.drop("_xml").schema
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out), FIELDS])

    def run(batches):
        pool = pool_of(digest, data)
        for b in batches:
            found = []
            for x in b.column(b.num_columns - 1).to_pylist():
                if pool.worn():
                    pool_of.cache_clear()
                    pool = pool_of(digest, data)
                found.append(validate_text(pool, x))
            wrong = [x for x in found if not x[0]]
            places = iter(range(len(wrong)))
            at = pa.array([None if x[0] else next(places) for x in found], pa.int32())  # valid documents have nulls
            columns = list(zip(*wrong)) if wrong else [[]] * len(_SCHEMA)
            arrays = [pa.array(list(c), f.type).take(at) for c, f in zip(columns[1:], list(_SCHEMA)[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x[0] for x in found], pa.bool_()), *arrays], schema=pa.schema([*list(b.schema)[:-1], *_SCHEMA]))

    return rows.mapInArrow(run, fields)


def validate_one(xml: str, schema: CompiledSchema) -> tuple:
    return validate_text(Pool(schema), xml)


def patterns(spark, schema: CompiledSchema, documents: list[str] = ()) -> DataFrame:
    """The pattern pool of a schema as a table (as far as the documents unfold it)."""
    pool = Pool(schema)
    for d in documents:
        validate_text(pool, d)
    return spark.createDataFrame(pool.rows(), "pid int, op string, left int, right int, nullable boolean, detail string")
