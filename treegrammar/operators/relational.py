"""Content models without Python: an element's content as a regular expression over child symbols.

Where children are all that counts (no text, data or interleave) a content model is a regular language.  Children are then
gathered in order, one character each, and checked by one rlike: no Python runs, and parents are grouped once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treegrammar.functions.names import Named
from treegrammar.plans.model import CompiledSchema


def content_regex(schema: CompiledSchema, element: str | None = None) -> tuple[str, dict[str, str]]:
    """(regular expression, child name -> symbol) of an element (the start element by default). Raises ValueError where the content is not of this kind."""
    symbols: dict[str, str] = {}

    def find(p):
        while p[0] == "ref":
            p = schema.rules[p[1]]
        return p

    def regex(p) -> str:
        p = find(p)
        kind = p[0]
        if kind == "empty":
            return ""
        if kind == "element" and isinstance(p[1], Named):
            return symbols.setdefault(p[1].local, chr(0x61 + len(symbols)) if len(symbols) < 26 else chr(0x4E00 + len(symbols)))
        if kind == "group":
            return "".join(map(regex, p[1]))
        if kind == "choice":
            return "(?:" + "|".join(map(regex, p[1])) + ")"
        if kind == "one_or_more":
            return f"(?:{regex(p[1])})+"
        raise ValueError(f"content with {kind} is no regular language over children")

    candidates = [find(schema.rules[schema.start])] if element is None else [p for p in map(find, schema.rules) if p[0] == "element" and isinstance(p[1], Named) and p[1].local == element]
    if not candidates or candidates[0][0] != "element":
        raise ValueError("no such element")
    return regex(candidates[0][2]), symbols


def children_valid(nodes: DataFrame, schema: CompiledSchema, parent: str, order: list[str], name: str, element: str | None = None) -> DataFrame:
    """(parent, valid) from a table of child nodes: parent key, columns that order siblings, and the child's name."""
    pattern, symbols = content_regex(schema, element)
    known = F.create_map(*(F.lit(x) for pair in symbols.items() for x in pair)) if symbols else None
    symbol: Column = F.coalesce(known[F.col(name)], F.lit("\x00")) if symbols else F.lit("\x00")
    one = nodes.select(parent, F.struct(*order, symbol.alias("s")).alias("n"))
    word = F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda n: n["s"]), "")
    return one.groupBy(parent).agg(word.rlike(f"\\A(?:{pattern})\\z").alias("valid"))
