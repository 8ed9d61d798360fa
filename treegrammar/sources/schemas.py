"""Schema files: loaders and the choice of syntax."""

from __future__ import annotations

from typing import Protocol

from treegrammar.errors import SchemaError
from treegrammar.syntax import compact, xmlform
from treegrammar.syntax.tree import Schema


class Loader(Protocol):
    def load(self, path: str) -> str: ...


class Disk:
    """Files that the driver can open."""

    def load(self, path: str) -> str:
        try:
            with open(path, encoding="utf-8") as f:
                return f.read()
        except OSError as e:
            raise SchemaError("Io", str(e), path) from None


class Memory(dict):
    """path -> text."""

    def load(self, path: str) -> str:
        if path not in self:
            raise SchemaError("Io", f"no such file: {path}", path)
        return self[path]


class Cluster:
    """Files that only Spark's readers reach (hdfs, object stores)."""

    def __init__(self, spark):
        self.spark = spark

    def load(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]


def parse(text: str, path: str, syntax: str = "auto", ns: str = "") -> Schema:
    """syntax: compact, xml, or auto (by ending, else by the first character)."""
    if syntax == "auto":
        syntax = "compact" if path.endswith(".rnc") else "xml" if path.endswith(".rng") or text.lstrip("﻿ \t\r\n").startswith("<") else "compact"
    return xmlform.parse(text, path, ns) if syntax == "xml" else compact.parse(text, path)
