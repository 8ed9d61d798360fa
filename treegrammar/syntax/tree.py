"""Syntax trees that both readers produce."""

from __future__ import annotations

from dataclasses import dataclass, field

Span = tuple[int, int]
INHERIT = object()  # the including file's namespace


@dataclass
class Name:
    """A name as written: prefix and local part, or a namespace that is already known."""

    local: str
    prefix: str | None = None
    ns: str | None = None
    span: Span = (0, 0)


@dataclass
class NcName:
    name: Name


@dataclass
class NcNs:
    prefix: str | None
    but: object = None
    ns: str | None = None
    span: Span = (0, 0)


@dataclass
class NcAny:
    but: object = None


@dataclass
class NcAlt:
    a: object
    b: object


@dataclass
class Element:
    names: object
    content: object
    span: Span = (0, 0)


@dataclass
class Attribute:
    names: object
    content: object
    span: Span = (0, 0)


@dataclass
class Pair:
    """op: ',' group, '&' interleave, '|' choice."""

    op: str
    left: object
    right: object


@dataclass
class Repeat:
    """op: '?', '*' or '+'."""

    op: str
    content: object


@dataclass
class ListOf:
    content: object
    span: Span = (0, 0)


@dataclass
class Mixed:
    content: object


@dataclass
class Ref:
    name: str
    span: Span = (0, 0)
    parent: bool = False


@dataclass
class Empty:
    pass


@dataclass
class Text:
    pass


@dataclass
class NotAllowed:
    pass


@dataclass
class TypeName:
    """A datatype: prefix and name, or a library that is already known; library '' holds string and token."""

    name: str
    prefix: str | None = None
    library: str | None = None
    span: Span = (0, 0)


@dataclass
class Value:
    type: TypeName | None
    text: str
    span: Span = (0, 0)
    namespaces: dict = field(default_factory=dict)


@dataclass
class Data:
    type: TypeName
    params: list[tuple[str, str]]
    but: object = None
    span: Span = (0, 0)


@dataclass
class External:
    href: str
    inherit: str | None = None
    ns: str | None = None
    span: Span = (0, 0)


@dataclass
class Grammar:
    content: list


@dataclass
class Define:
    """combine: '=', '|=' or '&='."""

    name: str
    combine: str
    content: object
    span: Span = (0, 0)


@dataclass
class Div:
    content: list


@dataclass
class Include:
    href: str
    overrides: list
    inherit: str | None = None
    ns: str | None = None
    span: Span = (0, 0)


@dataclass
class Namespace:
    prefix: str | None
    uri: object
    default: bool = False
    span: Span = (0, 0)


@dataclass
class Datatypes:
    prefix: str
    uri: str
    span: Span = (0, 0)


@dataclass
class Schema:
    decls: list
    body: object


def nodes(tree, file: str = "", parent: int | None = None, out: list | None = None) -> list[tuple]:
    """(file, node_id, parent_id, kind, name, start, end) of every node, for inspection as a table."""
    out = [] if out is None else out
    if isinstance(tree, (list, tuple)):
        for t in tree:
            nodes(t, file, parent, out)
    elif hasattr(tree, "__dataclass_fields__"):
        name = tree.name if isinstance(getattr(tree, "name", None), str) else getattr(tree, "local", None)
        span = getattr(tree, "span", (0, 0))
        me = len(out)
        out.append((file, me, parent, type(tree).__name__, name, span[0], span[1]))
        for f in tree.__dataclass_fields__:
            if f not in ("span", "namespaces"):
                nodes(getattr(tree, f), file, me, out)
    return out
