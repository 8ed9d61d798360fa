"""What a schema must not say although its syntax allows it, and where it leaves a choice of types.

check() raises a SchemaError of one kind for each rule:

- StartContent: the start is anything but elements and choices of them;
- ListContent: a list holds an element, an attribute, text, a list or an interleave;
- ExceptContent: a datatype's exception holds anything but data, values and choices of them;
- RepeatedAttribute: an attribute stands in a group or interleave that is repeated;
- DuplicateAttribute: two attributes of one group or interleave may have the same name;
- EndlessAttribute: an attribute with names without end is not repeated, or holds more than text;
- DataBesideContent: data, a value or a list stands beside elements, text or other data;
- InterleavedElements: two parts of an interleave may hold an element of the same name;
- InterleavedText: two parts of an interleave hold text.

competing() lists the elements whose type a document does not decide by name: two element patterns of one content that take the same
name and differ in what they hold.
"""

from __future__ import annotations

from treegrammar.errors import SchemaError
from treegrammar.functions.names import endless, overlap
from treegrammar.plans.model import CompiledSchema

NOTHING, COMPLEX, SIMPLE = range(3)  # content types


class Restrictions:
    def __init__(self, schema: CompiledSchema):
        self.schema = schema
        self.where = "start"

    def fail(self, kind: str, message: str):
        raise SchemaError(kind, f"{message} in {self.where}")

    def expand(self, p: tuple) -> tuple:
        """p without references down to its elements; what can't be matched is cut out."""
        kind = p[0]
        if kind == "ref":
            return self.expand(self.schema.rules[p[1]])
        if kind in ("group", "interleave"):
            parts = tuple(self.expand(q) for q in p[1])
            return ("not_allowed",) if ("not_allowed",) in parts else (kind, parts)
        if kind == "choice":
            parts = tuple(q for q in map(self.expand, p[1]) if q != ("not_allowed",))
            return ("choice", parts) if parts else ("not_allowed",)
        if kind in ("one_or_more", "list"):
            return (kind, self.expand(p[1]))
        if kind == "attribute":
            return (kind, p[1], self.expand(p[2]))
        if kind == "data_except":
            return (kind, p[1], self.expand(p[2]))
        return p

    def check(self) -> None:
        start = self.expand(self.schema.rules[self.schema.start])
        self.only(start, {"element", "choice", "not_allowed"}, "StartContent")
        seen, stack = set(), self.elements(start)
        while stack:
            element = stack.pop()
            if id(element[2]) in seen:
                continue
            seen.add(id(element[2]))
            self.where = f"element {element[1]}"
            body = self.expand(element[2])
            self.content_type(body, False, False)
            stack += self.elements(body)

    def only(self, p: tuple, kinds: set[str], error: str) -> None:
        if p[0] not in kinds:
            self.fail(error, f"{p[0].replace('_', ' ')} is not allowed here")
        for q in parts(p):
            self.only(q, kinds, error)

    def elements(self, p: tuple) -> list[tuple]:
        """The element patterns of a content."""
        return [p] if p[0] == "element" else [] if p[0] in ("attribute", "list", "data_except") else [e for q in parts(p) for e in self.elements(q)]

    def attributes(self, p: tuple) -> list[tuple]:
        return [p] if p[0] == "attribute" else [] if p[0] == "element" else [a for q in parts(p) for a in self.attributes(q)]

    def holds_text(self, p: tuple) -> bool:
        return p[0] == "text" or p[0] not in ("element", "attribute", "list", "data_except") and any(map(self.holds_text, parts(p)))

    def content_type(self, p: tuple, repeated: bool, grouped: bool) -> int:
        """What p holds, its own rules checked. repeated: it stands in a repetition; grouped: in a group or interleave of one."""
        kind = p[0]
        if kind in ("data", "value"):
            return SIMPLE
        if kind == "data_except":
            self.only(p[2], {"data", "value", "choice", "data_except", "not_allowed"}, "ExceptContent")
            return SIMPLE
        if kind == "list":
            self.only(p[1], {"data", "value", "choice", "group", "one_or_more", "empty", "data_except", "not_allowed"}, "ListContent")
            return SIMPLE
        if kind in ("text", "element"):
            return COMPLEX
        if kind == "attribute":
            if grouped:
                self.fail("RepeatedAttribute", f"attribute {p[1]} stands in a group that is repeated")
            if endless(p[1]) and (not repeated or p[2] != ("text",)):
                self.fail("EndlessAttribute", f"attribute {p[1]} must be repeated and hold text")
            self.content_type(p[2], False, False)
            return NOTHING
        if kind == "one_or_more":
            inner = self.content_type(p[1], True, grouped)
            self.beside(inner, inner)
            return inner
        if kind == "choice":
            return max((self.content_type(q, repeated, grouped) for q in p[1]), default=NOTHING)
        if kind in ("group", "interleave"):
            out = NOTHING
            for i, q in enumerate(p[1]):
                here = self.content_type(q, repeated, grouped or repeated)
                self.beside(out, here)
                out = max(out, here)
                for other in p[1][:i]:
                    self.apart(kind, other, q)
            return out
        return NOTHING

    def beside(self, a: int, b: int) -> None:
        if a and b and SIMPLE in (a, b):
            self.fail("DataBesideContent", "data stands beside other content")

    def apart(self, kind: str, a: tuple, b: tuple) -> None:
        for x in self.attributes(a):
            for y in self.attributes(b):
                if overlap(x[1], y[1]):
                    self.fail("DuplicateAttribute", f"attribute {y[1]} may stand twice")
        if kind == "interleave":
            for x in self.elements(a):
                for y in self.elements(b):
                    if overlap(x[1], y[1]):
                        self.fail("InterleavedElements", f"element {y[1]} stands in two parts of an interleave")
            if self.holds_text(a) and self.holds_text(b):
                self.fail("InterleavedText", "text stands in two parts of an interleave")


def parts(p: tuple) -> tuple:
    kind = p[0]
    return p[1] if kind in ("group", "interleave", "choice") else (p[1],) if kind in ("one_or_more", "list") else (p[2],) if kind in ("attribute", "data_except") else ()


def check(schema: CompiledSchema) -> CompiledSchema:
    """The schema, if it keeps all rules."""
    Restrictions(schema).check()
    return schema


def competing(schema: CompiledSchema) -> list[tuple[str, str, str]]:
    """(parent, a child's names, names that another pattern takes too) wherever a child's name leaves a choice of contents."""
    r = Restrictions(schema)
    start = r.expand(schema.rules[schema.start])
    out, seen, stack = set(), set(), [("", start)]
    while stack:
        name, body = stack.pop()
        found = r.elements(body)
        for i, a in enumerate(found):
            for b in found[:i]:
                if a[2] != b[2] and overlap(a[1], b[1]):
                    out.add((name, str(b[1]), str(a[1])))
            if id(a[2]) not in seen:
                seen.add(id(a[2]))
                stack.append((str(a[1]), r.expand(a[2])))
    return sorted(out)
