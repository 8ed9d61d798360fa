"""Reader of the XML syntax: expat events become elements, elements become the same trees as the compact syntax."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field
from xml.parsers import expat

from treegrammar.errors import SchemaError
from treegrammar.functions.text import NCNAME
from treegrammar.syntax import tree as t

RNG = "http://relaxng.org/ns/structure/1.0"
XML = "http://www.w3.org/XML/1998/namespace"
XMLNS = "http://www.w3.org/2000/xmlns"
_NAME = re.compile(NCNAME)


@dataclass
class Node:
    ns: str
    local: str
    attrs: dict[str, str]  # without a namespace
    base: str
    library: str
    scope_ns: str
    prefixes: dict[str, str]
    span: t.Span
    children: list = field(default_factory=list)
    text: str = ""


def load(text: str, file: str, ns: str = "") -> Node:
    """The element tree; foreign elements are left out. ns: what an including file hands down."""
    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.buffer_text = True
    stack: list[Node] = []
    roots: list[Node] = []

    def start(name, flat):
        raw = dict(zip(flat[::2], flat[1::2]))
        up = stack[-1] if stack else Node("", "", {}, "", "", ns, {"xml": XML}, (0, 0))
        prefixes = dict(up.prefixes)
        for k, v in raw.items():
            if k == "xmlns":
                prefixes[""] = v
            elif k.startswith("xmlns:"):
                prefixes[k[6:]] = v
        prefix, _, local = name.rpartition(":")
        if prefix and prefix not in prefixes:
            raise SchemaError("UndefinedNamespacePrefix", f"prefix {prefix}", file, (parser.CurrentByteIndex,) * 2)
        attrs = {k: v.strip() if k in ("name", "type", "combine", "href") else v for k, v in raw.items() if ":" not in k and k != "xmlns"}
        base = posixpath.join(up.base, raw["xml:base"]) if "xml:base" in raw else up.base
        library = attrs.get("datatypeLibrary", up.library)
        node = Node(prefixes.get(prefix, ""), local, attrs, base, library, attrs.get("ns", up.scope_ns), prefixes, (parser.CurrentByteIndex, parser.CurrentByteIndex + len(name) + 1))
        if stack:
            if node.ns == RNG:
                stack[-1].children.append(node)
        else:
            roots.append(node)
        stack.append(node)

    def chars(s):
        if stack:
            stack[-1].text += s

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: stack.pop(), chars
    try:
        parser.Parse(text.encode("utf-8"), True)
    except expat.ExpatError as e:
        raise SchemaError("XmlParse", str(e), file, (parser.CurrentByteIndex,) * 2) from None
    return roots[0]


class Reader:
    #: Attributes each element may carry besides ns and datatypeLibrary.
    ALLOWED = {
        "element": {"name"}, "attribute": {"name"}, "ref": {"name"}, "parentRef": {"name"}, "value": {"type"}, "data": {"type"}, "param": {"name"},
        "externalRef": {"href"}, "include": {"href"}, "start": {"combine"}, "define": {"name", "combine"},
    }

    def __init__(self, file: str):
        self.file = file

    def fail(self, node: Node, message: str, kind: str = "Expected"):
        raise SchemaError(kind, message, self.file, node.span)

    def check(self, node: Node) -> None:
        extra = set(node.attrs) - self.ALLOWED.get(node.local, set()) - {"ns", "datatypeLibrary"}
        if extra:
            self.fail(node, f"<{node.local}> takes no attribute {sorted(extra)[0]}", "UnexpectedAttribute")
        if (uri := node.attrs.get("datatypeLibrary")) and (":" not in uri or "#" in uri or " " in uri):
            self.fail(node, f"{uri!r} is no datatype library", "InvalidDatatypeLibrary")
        if node.local not in ("value", "param", "name") and node.text.strip():
            self.fail(node, f"<{node.local}> holds no text", "UnexpectedText")

    def required(self, node: Node, key: str, ncname: bool = True) -> str:
        if key not in node.attrs:
            self.fail(node, f"<{node.local}> needs the attribute {key}")
        if ncname and not _NAME.fullmatch(node.attrs[key]):
            self.fail(node, f"{node.attrs[key]!r} is no name", "InvalidName")
        return node.attrs[key]

    def no_children(self, node: Node) -> None:
        if node.children:
            self.fail(node.children[0], f"<{node.local}> holds no elements", "UnexpectedElement")

    def schema(self, node: Node) -> t.Schema:
        if node.ns != RNG:
            self.fail(node, "the root is no schema element")
        return t.Schema([], self.pattern(node))

    def group(self, node: Node, children: list[Node] | None = None, op: str = ","):
        found = [self.pattern(c) for c in (node.children if children is None else children)]
        if not found:
            self.fail(node, f"<{node.local}> is empty")
        out = found[-1]
        for p in reversed(found[:-1]):
            out = t.Pair(op, p, out)
        return out

    def pattern(self, node: Node):
        self.check(node)
        kind = node.local
        if kind in ("element", "attribute"):
            return self.named(node)
        if kind in ("group", "interleave", "choice"):
            return self.group(node, None, {"group": ",", "interleave": "&", "choice": "|"}[kind])
        if kind in ("optional", "zeroOrMore", "oneOrMore"):
            return t.Repeat({"optional": "?", "zeroOrMore": "*", "oneOrMore": "+"}[kind], self.group(node))
        if kind == "list":
            return t.ListOf(self.group(node), node.span)
        if kind == "mixed":
            return t.Mixed(self.group(node))
        if kind in ("ref", "parentRef"):
            self.no_children(node)
            return t.Ref(self.required(node, "name"), node.span, kind == "parentRef")
        if kind in ("empty", "text", "notAllowed"):
            self.no_children(node)
            return {"empty": t.Empty, "text": t.Text, "notAllowed": t.NotAllowed}[kind]()
        if kind == "value":
            self.no_children(node)
            type_ = t.TypeName(node.attrs["type"], None, node.library, node.span) if "type" in node.attrs else None
            return t.Value(type_, node.text, node.span, {**node.prefixes, "": node.scope_ns})
        if kind == "data":
            params = [(self.required(c, "name"), c.text) for c in node.children if c.local == "param"]
            rest = [c for c in node.children if c.local != "param"]
            if [c.local for c in rest] not in ([], ["except"]) or (rest and node.children[-1] is not rest[0]):
                self.fail(node, "parameters and then one except may stand in <data>", "UnexpectedElement")
            but = self.group(rest[0], None, "|") if rest else None
            name = self.required(node, "type")
            return t.Data(t.TypeName(name, None, "" if name in ("token", "string") and not node.library else node.library, node.span), params, but, node.span)
        if kind == "externalRef":
            self.no_children(node)
            return t.External(posixpath.join(node.base, self.required(node, "href", False)), None, node.scope_ns, node.span)
        if kind == "grammar":
            return t.Grammar(self.content(node))
        self.fail(node, f"<{kind}> is no pattern")

    def named(self, node: Node):
        rest = list(node.children)
        if "name" in node.attrs:
            names = self.qname(node, node.attrs["name"], node.local == "attribute" and "ns" not in node.attrs)
        else:
            if not rest:
                self.fail(node, f"<{node.local}> has no name")
            names = self.names(rest.pop(0))
        if node.local == "element":
            return t.Element(names, self.group(node, rest), node.span)
        if isinstance(names, t.NcName) and ((names.name.ns == "" and names.name.local == "xmlns") or names.name.ns == XMLNS):
            self.fail(node, "an attribute can't be named xmlns", "InvalidName")
        if len(rest) > 1:
            self.fail(rest[1], "<attribute> holds one pattern", "UnexpectedElement")
        return t.Attribute(names, self.pattern(rest[0]) if rest else t.Text(), node.span)

    def qname(self, node: Node, text: str, local_only: bool = False):
        prefix, _, local = text.strip().rpartition(":")
        if not _NAME.fullmatch(local) or (prefix and not _NAME.fullmatch(prefix)):
            self.fail(node, f"{text!r} is no name", "InvalidName")
        if prefix and prefix not in node.prefixes:
            self.fail(node, f"prefix {prefix}", "UndefinedNamespacePrefix")
        return t.NcName(t.Name(local, None, node.prefixes[prefix] if prefix else "" if local_only else node.scope_ns, node.span))

    def names(self, node: Node, inside: str = ""):
        if node.local == "name":
            return self.qname(node, node.text)
        if node.local in ("anyName", "nsName"):
            if node.local == "anyName" and inside or node.local == "nsName" and inside == "nsName":
                self.fail(node, f"<{node.local}> can't stand in this except", "UnexpectedElement")
            if [c.local for c in node.children] not in ([], ["except"]):
                self.fail(node, "one except may stand here", "UnexpectedElement")
            but = self.either(node.children[0], node.local) if node.children else None
            return t.NcAny(but) if node.local == "anyName" else t.NcNs(None, but, node.scope_ns, node.span)
        if node.local == "choice":
            return self.either(node, inside)
        self.fail(node, f"<{node.local}> is no name class")

    def either(self, node: Node, inside: str = ""):
        found = [self.names(c, inside) for c in node.children]
        if not found:
            self.fail(node, f"<{node.local}> is empty")
        out = found[0]
        for n in found[1:]:
            out = t.NcAlt(out, n)
        return out

    def content(self, node: Node, include: bool = False) -> list:
        out = []
        for c in node.children:
            self.check(c)
            if c.local in ("start", "define"):
                combine = c.attrs.get("combine")
                if combine not in (None, "choice", "interleave"):
                    self.fail(c, f"combine can't be {combine}", "InvalidCombine")
                if c.local == "start" and len(c.children) != 1:
                    self.fail(c, "<start> holds one pattern", "UnexpectedElement")
                name = "start" if c.local == "start" else self.required(c, "name")
                out.append(t.Define(name, {None: "=", "choice": "|=", "interleave": "&="}[combine], self.group(c), c.span))
            elif c.local == "div":
                out.append(t.Div(self.content(c, include)))
            elif c.local == "include" and not include:
                out.append(t.Include(posixpath.join(c.base, self.required(c, "href", False)), self.content(c, True), None, c.scope_ns, c.span))
            else:
                self.fail(c, f"<{c.local}> can't stand here", "UnexpectedElement")
        return out


def parse(text: str, file: str = "", ns: str = "") -> t.Schema:
    return Reader(file).schema(load(text, file, ns))
