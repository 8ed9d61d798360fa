"""Validation of streams of document parts: a document is validated while it arrives, in pieces of any size.

The state of a document is the pattern that is left of the schema, written out node by node so that another pool on another worker can go
on with it, and what has been read of an open text or start tag.  Parts that come before their turn wait in the state; a document
that is not heard of for a while is given up.

Defined results: one row a document, when its last part has come or it is given up (error_kind abandoned); what a document has got
wrong first is what it is reported for; parts that come twice count once; parts after the last one are ignored as long as the document is
remembered, which is until its row is written.  Null documents have no parts, and so no row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treegrammar.functions.sql import EXTERNAL, PARTS, parts
from treegrammar.functions.text import is_whitespace
from treegrammar.operators.pool import Pool
from treegrammar.operators.validate import pool_of, uses_qnames
from treegrammar.plans.model import CompiledSchema

DONE = "done"  # the kind of a document's last part
_ENTITY = expat.ErrorString(expat.errors.codes[expat.errors.XML_ERROR_UNDEFINED_ENTITY])


def part_rows(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """id_col and functions.sql.PARTS of each document, a row of kind done at its end: what a stream of parts holds."""
    rows = docs.select(F.col(id_col), F.col(xml_col).cast("string").alias("xml"))
    names = [f.split()[0] for f in PARTS.split(", ")]
    types = [{"int": pa.int32(), "string": pa.string()}[f.split()[1]] for f in PARTS.split(", ")]

    def run(batches):
        for b in batches:
            for i, xml in enumerate(b.column(1).to_pylist()):
                if xml is not None:
                    found = parts(xml)
                    found.append((len(found), 0, DONE, None, None, None, None, None))
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(found), b.column(0).type), *(pa.array(c, t) for c, t in zip(zip(*found), types))], names=[b.schema.names[0], *names])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {PARTS}")


class PartRun:
    """One document's way through the automaton, a part at a time."""

    def __init__(self, pool: Pool, saved: bytes | None = None):
        self.pool = pool
        if saved is None:
            self.state, self.next, self.text, self.leaf, self.tag, self.kind, self.waiting = pool.start, 0, [], False, False, None, {}
        else:
            nodes, self.next, self.text, self.leaf, self.tag, self.kind, self.waiting = pickle.loads(saved)
            self.state = pool.imported(nodes)

    def saved(self) -> bytes:
        return pickle.dumps((self.pool.exported(self.state), self.next, self.text, self.leaf, self.tag, self.kind, self.waiting))

    def go(self, state: int, kind: str) -> None:
        if state == self.pool.NONE:
            self.kind = kind
        else:
            self.state = state

    def take_text(self) -> None:
        s = "".join(self.text)
        self.text = []
        if not is_whitespace(s):
            self.go(self.pool.text(self.state, s), "text")

    def read(self, kind: str, ns: str | None, local: str | None, value: str | None) -> bool:
        """Takes the next part; True if it was the last one."""
        pool = self.pool
        if kind == DONE:
            if self.kind is None and not pool.nullable[self.state]:
                self.kind = "document-end"
            return True
        if self.kind is not None:
            return False
        if self.tag and kind != "attribute":
            self.tag = False
            self.go(pool.close(self.state), "element-open-end")
            if self.kind:
                return False
        if kind == "error":
            self.kind = "undefined_entity" if value == _ENTITY else "external_entity" if value == EXTERNAL else "xml"
        elif kind in ("element", "attribute") and ns is None:
            if kind == "element":
                self.take_text()
            self.kind = self.kind or "undefined_namespace_prefix"
        elif kind == "element":
            self.take_text()
            if self.kind is None:
                self.go(pool.open(self.state, ns, local), "element-start")
            self.tag = self.leaf = True
        elif kind == "attribute":
            self.go(pool.att(self.state, ns, local, value), "attribute")
        elif kind == "text":
            self.text.append(value)
        elif kind == "end":
            if self.leaf:
                s, self.text, self.leaf = "".join(self.text), [], False
                self.go(pool.leaf(self.state, s), "text")
            else:
                self.take_text()
            if self.kind is None:
                self.go(pool.end(self.state), "element-close")
        return False

    def take(self, rows) -> bool:
        """Takes parts (n, kind, ns, local, value) in any order, as far as their turn has come; True if the last one was among them."""
        for n, *part in rows:
            if n >= self.next:
                self.waiting[n] = tuple(part)
        while self.next in self.waiting:
            part = self.waiting.pop(self.next)
            self.next += 1
            if self.read(*part):
                return True
        return False


def validate_parts(stream: DataFrame, schema: CompiledSchema, id_col: str = "doc_id", patience_ms: int = 3_600_000) -> DataFrame:
    """(id_col, valid, error_kind, parts) of every document of a stream of part_rows(); works on tables too, where nothing is given up.

    patience_ms: how long a document may go without a new part."""
    data = cloudpickle.dumps(schema)
    name = "parts-" + str(hash(data))
    if uses_qnames(Pool(schema)):
        raise ValueError("QName values need the prefixes in scope")
    rows = stream.select(id_col, "n", "kind", "ns", "local", "value")
    fields = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, valid boolean, error_kind string, parts long"

    def result(key, run: PartRun) -> pd.DataFrame:
        return pd.DataFrame([(key, run.kind is None, run.kind, run.next)], columns=[id_col, "valid", "error_kind", "parts"])

    def ordered(frames) -> list[tuple]:
        got = [[None if x is None or x is pd.NA or x != x else x for x in r] for f in frames for r in f[["n", "kind", "ns", "local", "value"]].itertuples(index=False)]
        return [(int(n), *rest) for n, *rest in got]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if (pool := pool_of(name, data)).worn():
            pool_of.cache_clear()
            pool = pool_of(name, data)
        run = PartRun(pool, state.get[0] if state.exists else None)
        if state.hasTimedOut:
            run.kind = run.kind or "abandoned"
            state.remove()
            yield result(key[0], run)
            return
        if run.take(ordered(frames)):
            if state.exists:
                state.remove()
            yield result(key[0], run)
        else:
            state.update((run.saved(),))
            state.setTimeoutDuration(patience_ms)

    if stream.isStreaming:
        return rows.groupBy(id_col).applyInPandasWithState(step, fields, "run binary", "append", GroupStateTimeout.ProcessingTimeTimeout)

    def whole(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        run = PartRun(pool_of(name, data))
        if not run.take(ordered([frame])):
            run.kind = run.kind or "abandoned"
        return result(key[0], run)

    return rows.groupBy(id_col).applyInPandas(whole, fields)
