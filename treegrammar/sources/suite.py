"""Conformance suites: nested testSuite elements with testCase records (resources, schema, valid and invalid documents)."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treegrammar.errors import SchemaError
from treegrammar.operators.validate import validate_one
from treegrammar.plans.model import compile_schema
from treegrammar.sources.schemas import Memory

FIELDS = "section string, documentation string, kind string, resources map<string,string>, valid array<string>, invalid array<string>"


def inner(node: ET.Element) -> str:
    return (node.text or "").strip() if not len(node) else ET.tostring(node[0], encoding="unicode")


def cases(text: str) -> list[tuple]:
    """One tuple of FIELDS for each case. Main files are called correct.rng or incorrect.rng."""
    out = []

    def resources(node: ET.Element, folder: str, into: dict[str, str]) -> None:
        for r in node.findall("resource"):
            into[folder + r.get("name")] = inner(r)
        for d in node.findall("dir"):
            resources(d, f"{folder}{d.get('name')}/", into)

    def suite(node: ET.Element) -> None:
        for n in node:
            if n.tag == "testSuite":
                suite(n)
            elif n.tag == "testCase":
                kind = "incorrect" if n.find("incorrect") is not None else "correct"
                files: dict[str, str] = {}
                resources(n, "", files)
                if (main := n.find(kind)) is not None:
                    files[f"{kind}.rng"] = inner(main)
                out.append((n.findtext("section"), n.findtext("documentation"), kind, files, [inner(v) for v in n.findall("valid")], [inner(v) for v in n.findall("invalid")]))

    suite(ET.fromstring(text))
    return out


def outcome(kind: str, resources: dict[str, str], valid: list[str], invalid: list[str]) -> str:
    """passed, or what went wrong; every document of a case is checked."""
    try:
        schema = compile_schema(f"{kind}.rng", Memory(resources), "auto")
    except SchemaError as e:
        return "passed" if kind == "incorrect" else f"schema: {e.kind}"
    if kind == "incorrect":
        return "schema accepted"
    wrong = [f"valid {i}" for i, d in enumerate(valid) if not validate_one(d, schema)[0]] + [f"invalid {i}" for i, d in enumerate(invalid) if validate_one(d, schema)[0]]
    return ", ".join(wrong) or "passed"


def run_suites(suites: DataFrame, id_col: str = "suite_id", text_col: str = "text") -> DataFrame:
    """(id_col, nth, section, kind, outcome): the cases of a table of suites, read and run on the executors.

    A suite that is null has no cases; one that is not well-formed has one row, whose outcome says so; other columns are ignored.
    """
    rows = suites.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    names = ["nth", "section", "kind", "outcome"]
    types = [pa.int32(), pa.string(), pa.string(), pa.string()]

    def each(text: str | None) -> list[tuple]:
        try:
            return [(n, section, kind, outcome(kind, *rest)) for n, (section, _, kind, *rest) in enumerate(cases(text))] if text is not None else []
        except ET.ParseError as e:
            return [(0, None, None, f"suite: {e}")]

    def run(batches):
        for b in batches:
            for key, text in zip(b.column(0), b.column(1).to_pylist()):  # a suite at a time
                if found := each(text):
                    keys = pa.array([key.as_py()] * len(found), b.column(0).type)
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(zip(*found), types))], names=[b.schema.names[0], *names])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, nth int, section string, kind string, outcome string")


def run_suite(spark: SparkSession, text: str) -> DataFrame:
    """The cases with their outcomes; cases run on the executors, a batch of them at a time."""
    table = spark.createDataFrame(cases(text), FIELDS)

    def run(batches):
        for b in batches:
            found = [outcome(r["kind"], dict(r["resources"]), r["valid"], r["invalid"]) for r in b.to_pylist()]
            yield b.append_column("outcome", pa.array(found, pa.string()))

    return table.mapInArrow(run, f"{FIELDS}, outcome string")
