"""The schema compiler: trees to numbered rules, with scopes, includes, overrides and combination."""

from __future__ import annotations

import posixpath
from contextlib import contextmanager
from dataclasses import dataclass, field

from treegrammar.errors import Place, SchemaError
from treegrammar.functions import names as nc
from treegrammar.functions.datatypes import BUILTIN, XSD, compile_datatype, compile_value
from treegrammar.sources.schemas import Loader, parse
from treegrammar.syntax import tree as t

XML_NS = "http://www.w3.org/XML/1998/namespace"
EMPTY, TEXT, NOT_ALLOWED = ("empty",), ("text",), ("not_allowed",)


@dataclass
class CompiledSchema:
    """rules[i] is a pattern of nested tuples; ('ref', i) points at a rule. Small, picklable, and sent to the workers once."""

    rules: list
    names: list[str]
    start: int
    loaded: list[str]


@dataclass
class Rule:
    number: int
    name: str
    pattern: object = None
    assigned: bool = False
    combine: str | None = None
    span: t.Span = (0, 0)
    file: str = ""
    came: tuple[Place, ...] = ()  # the includes around the place where it was met first
    defined: Place | None = None
    combined: Place | None = None


@dataclass
class Scope:
    """The definitions of one grammar."""

    parent: Scope | None
    rules: dict[str, Rule] = field(default_factory=dict)


@dataclass
class Context:
    """What one file (or one use of it) knows."""

    file: str
    scope: Scope
    prefixes: dict[str, str]
    libraries: dict[str, str]
    default: str = ""
    includes: tuple[str, ...] = ()
    overridden: dict[str, bool] | None = None  # names that an include replaces, and whether they were met
    attribute: Place | None = None  # the attribute that is open
    declared: dict[str, t.Span] = field(default_factory=dict)  # datatype prefixes


class Compiler:
    def __init__(self, loader: Loader, syntax: str = "auto", compat: bool = False):
        self.loader, self.syntax, self.compat = loader, syntax, compat
        self.texts: dict[str, str] = {}
        self.trees: dict[tuple[str, str], t.Schema] = {}
        self.rules: list[Rule] = []
        self.chain: list[Place] = []  # includes that are open, outermost first

    def compile(self, path: str) -> CompiledSchema:
        scope = Scope(None)
        tree = self.tree(path)
        ctx = self.context(path, scope)
        self.declare(tree, ctx)
        if isinstance(tree.body, t.Grammar):
            self.contents(tree.body.content, ctx)
        else:
            self.define(ctx, "start", "=", self.pattern(tree.body, ctx), (0, 0))
        start = scope.rules.get("start")
        if start is None or start.pattern is None:
            raise SchemaError("StartRuleMissing", "the grammar has no start", path)
        for r in self.rules:
            if r.pattern is None:
                raise SchemaError("UndefinedReference", f"{r.name} is not defined", r.file, r.span, r.came)
        self.check_recursion()
        return CompiledSchema([r.pattern for r in self.rules], [r.name for r in self.rules], start.number, sorted(self.texts))

    # ---- files

    def tree(self, path: str, ns: str = "") -> t.Schema:
        if path not in self.texts:
            self.texts[path] = self.loader.load(path)
        if (path, ns) not in self.trees:
            self.trees[path, ns] = parse(self.texts[path], path, self.syntax, ns)
        return self.trees[path, ns]

    def context(self, path: str, scope: Scope, default: str = "", includes: tuple[str, ...] = (), overridden=None) -> Context:
        return Context(path, scope, {"xml": XML_NS}, {"xsd": XSD}, default, (*includes, path), overridden)

    def fail(self, kind: str, message: str, ctx: Context, span: t.Span = (0, 0), *places: Place | None):
        raise SchemaError(kind, message, ctx.file, span, tuple(p for p in places if p))

    @contextmanager
    def inside(self, note: str, ctx: Context, span: t.Span):
        """Errors that are raised within name this place too."""
        self.chain.append(Place(note, ctx.file, *span))
        try:
            yield
        except SchemaError as e:
            e.places += (self.chain[-1],)
            raise
        finally:
            self.chain.pop()

    def declare(self, tree: t.Schema, ctx: Context) -> None:
        for d in tree.decls:
            if isinstance(d, t.Datatypes):
                if ctx.libraries.get(d.prefix, d.uri) != d.uri:
                    self.fail("DatatypesPrefixRedefined", f"prefix {d.prefix} is declared twice", ctx, d.span, Place("first declared here", ctx.file, *ctx.declared[d.prefix]) if d.prefix in ctx.declared else None)
                ctx.declared.setdefault(d.prefix, d.span)
                ctx.libraries[d.prefix] = d.uri
                continue
            uri = ctx.default if d.uri is t.INHERIT else d.uri
            if d.prefix:
                if d.prefix == "xmlns" or (d.prefix == "xml") != (uri == XML_NS):
                    self.fail("InvalidNamespace", f"prefix {d.prefix} can't be declared so", ctx, d.span)
                ctx.prefixes.setdefault(d.prefix, uri)
            if d.default:
                ctx.default = uri

    def inherited(self, node, ctx: Context) -> str:
        if node.inherit is not None:
            return self.prefix(node.inherit, ctx, node.span)
        return node.ns if node.ns is not None else ctx.default

    def include(self, node: t.Include, ctx: Context) -> None:
        path = posixpath.normpath(posixpath.join(posixpath.dirname(ctx.file), node.href))
        if path in ctx.includes:
            self.fail("RecursiveInclude", f"{path} includes itself", ctx, node.span)
        replaced: dict[str, bool] = {}
        own: list[t.Define] = []

        def collect(content):
            for c in content:
                if isinstance(c, t.Div):
                    collect(c.content)
                else:
                    own.append(c)
                    replaced[c.name] = False

        collect(node.overrides)
        ns = self.inherited(node, ctx)
        with self.inside("included here", ctx, node.span):
            tree = self.tree(path, ns)
        if not isinstance(tree.body, t.Grammar):
            self.fail("ExpectedGrammar", f"{path} is no grammar", ctx, node.span, Place("no grammar", path, 0, 0))
        inner = self.context(path, ctx.scope, ns, ctx.includes, replaced)
        if node.inherit is not None:
            inner.prefixes.setdefault(node.inherit, ns)
        outer = ctx.overridden
        for d in own:  # an include's own definitions may be replaced in turn
            self.define(ctx, d.name, d.combine, self.pattern(d.content, ctx), d.span)
        with self.inside("included here", ctx, node.span):
            self.declare(tree, inner)
            self.contents(tree.body.content, inner)
        for name, met in replaced.items():
            if not met:
                self.fail("DefineNotFound", f"{path} has no {name} to replace", ctx, next(d.span for d in own if d.name == name), Place("not in this file", path, 0, 0))
        if outer:
            for name in replaced:
                if name in outer:
                    outer[name] = True

    def external(self, node: t.External, ctx: Context):
        path = posixpath.normpath(posixpath.join(posixpath.dirname(ctx.file), node.href))
        if path in ctx.includes:
            self.fail("RecursiveInclude", f"{path} refers to itself", ctx, node.span)
        ns = self.inherited(node, ctx)
        with self.inside("used here", ctx, node.span):
            tree = self.tree(path, ns)
            inner = self.context(path, Scope(None), ns, ctx.includes)
            inner.attribute = ctx.attribute
            if node.inherit is not None:
                inner.prefixes.setdefault(node.inherit, ns)
            self.declare(tree, inner)
            if isinstance(tree.body, t.Grammar):
                return self.grammar(tree.body, inner)
            return self.pattern(tree.body, inner)

    def grammar(self, node: t.Grammar, ctx: Context):
        self.contents(node.content, ctx)
        start = ctx.scope.rules.get("start")
        if start is None or start.pattern is None:
            self.fail("StartRuleMissing", "a grammar has no start", ctx)
        return ("ref", start.number)

    # ---- definitions

    def contents(self, content: list, ctx: Context) -> None:
        for c in content:
            if isinstance(c, t.Div):
                self.contents(c.content, ctx)
            elif isinstance(c, t.Include):
                self.include(c, ctx)
            else:
                self.define(ctx, c.name, c.combine, self.pattern(c.content, ctx), c.span)

    def rule(self, scope: Scope, name: str, ctx: Context, span: t.Span) -> Rule:
        if name not in scope.rules:
            self.rules.append(Rule(len(self.rules), name, span=span, file=ctx.file, came=tuple(reversed(self.chain))))
            scope.rules[name] = self.rules[-1]
        return scope.rules[name]

    def define(self, ctx: Context, name: str, combine: str, pattern, span: t.Span) -> None:
        if ctx.overridden is not None and name in ctx.overridden:
            ctx.overridden[name] = True
            return
        r = self.rule(ctx.scope, name, ctx, span)
        if combine == "=":
            if r.assigned:
                self.fail("DuplicateDefinition", f"{name} is defined twice", ctx, span, r.defined)
            r.assigned = True
        elif r.combine not in (None, combine):
            self.fail("ConflictingCombine", f"{name} is combined in two ways", ctx, span, r.combined)
        else:
            r.combine = combine
            r.combined = r.combined or Place("first combined here", ctx.file, *span)
        if r.pattern is None:
            r.pattern, r.defined = pattern, Place("first defined here", ctx.file, *span)
        elif r.combine is None:
            self.fail("DuplicateDefinition", f"{name} is defined twice", ctx, span, r.defined)
        else:
            r.pattern = flat("choice" if r.combine == "|=" else "interleave", [r.pattern, pattern])

    def check_recursion(self) -> None:
        """A rule may reach itself only through an element."""
        state = [0] * len(self.rules)
        path: list[int] = []

        def visit(n: int) -> None:
            state[n] = 1
            path.append(n)
            stack = [self.rules[n].pattern]
            while stack:
                p = stack.pop()
                if p[0] == "ref":
                    if state[p[1]] == 1:
                        r = self.rules[p[1]]
                        raise SchemaError("RecursiveReference", f"{r.name} holds itself outside an element", r.file, r.span, tuple(Place(f"by way of {q.name}", q.file, *q.span) for q in (self.rules[m] for m in path[path.index(p[1]) + 1 :])) + r.came)
                    if state[p[1]] == 0:
                        visit(p[1])
                elif p[0] != "element":
                    stack += [q for q in p[1:] if isinstance(q, tuple) and q and isinstance(q[0], str)] if p[0] not in ("choice", "group", "interleave") else list(p[1])
            state[n] = 2
            path.pop()

        for n in range(len(self.rules)):
            if state[n] == 0:
                visit(n)

    # ---- patterns

    def pattern(self, node, ctx: Context):
        kind = type(node)
        if kind is t.Pair:
            return flat({",": "group", "&": "interleave", "|": "choice"}[node.op], [self.pattern(node.left, ctx), self.pattern(node.right, ctx)])
        if kind is t.Repeat:
            p = self.pattern(node.content, ctx)
            return {"?": lambda: ("choice", (p, EMPTY)), "*": lambda: ("choice", (("one_or_more", p), EMPTY)), "+": lambda: ("one_or_more", p)}[node.op]()
        if kind is t.Element:
            if ctx.attribute:
                self.fail("ElementInAttribute", "an attribute can't hold an element", ctx, node.span, ctx.attribute)
            return ("element", self.names(node.names, ctx, False), self.pattern(node.content, ctx))
        if kind is t.Attribute:
            if ctx.attribute:
                self.fail("AttributeInAttribute", "an attribute can't hold an attribute", ctx, node.span, ctx.attribute)
            ctx.attribute = Place("in this attribute", ctx.file, *node.span)
            try:
                return ("attribute", self.names(node.names, ctx, True), self.pattern(node.content, ctx))
            finally:
                ctx.attribute = None
        if kind is t.Ref:
            scope = ctx.scope.parent if node.parent else ctx.scope
            if scope is None:
                self.fail("NoParentScope", "there is no parent grammar", ctx, node.span)
            return ("ref", self.rule(scope, node.name, ctx, node.span).number)
        if kind is t.Empty:
            return EMPTY
        if kind is t.Text:
            return TEXT
        if kind is t.NotAllowed:
            return NOT_ALLOWED
        if kind is t.ListOf:
            return ("list", self.pattern(node.content, ctx))
        if kind is t.Mixed:
            return ("interleave", (self.pattern(node.content, ctx), TEXT))
        if kind is t.Value:
            return ("value", self.value(node, ctx))
        if kind is t.Data:
            library, name = self.library(node.type, ctx)
            try:
                data = compile_datatype(library, name, node.params, self.compat)
            except SchemaError as e:
                self.fail(e.kind, e.message, ctx, node.span)
            return ("data", data) if node.but is None else ("data_except", data, self.pattern(node.but, ctx))
        if kind is t.External:
            return self.external(node, ctx)
        if kind is t.Grammar:
            inner = Context(ctx.file, Scope(ctx.scope), ctx.prefixes, ctx.libraries, ctx.default, ctx.includes, None, ctx.attribute)
            return self.grammar(node, inner)
        raise TypeError(kind)

    def library(self, type_: t.TypeName, ctx: Context) -> tuple[str, str]:
        if type_.library is not None:
            return type_.library, type_.name
        if type_.prefix not in ctx.libraries:
            self.fail("UndefinedDatatypePrefix", f"prefix {type_.prefix}", ctx, type_.span)
        return ctx.libraries[type_.prefix], type_.name

    def value(self, node: t.Value, ctx: Context):
        library, name = self.library(node.type, ctx) if node.type else (BUILTIN, "token")
        ns = ""
        if name == "QName" and library:
            prefix = node.text.strip().rpartition(":")[0]
            known = node.namespaces or ctx.prefixes
            if prefix and prefix not in known:
                self.fail("UndefinedNamespacePrefix", f"prefix {prefix}", ctx, node.span)
            ns = known[prefix] if prefix else node.namespaces.get("", ctx.default)
        try:
            return compile_value(library, name, node.text, ns)
        except SchemaError as e:
            self.fail(e.kind, e.message, ctx, node.span)

    def prefix(self, prefix: str, ctx: Context, span: t.Span) -> str:
        if prefix not in ctx.prefixes:
            self.fail("UndefinedNamespacePrefix", f"prefix {prefix}", ctx, span)
        return ctx.prefixes[prefix]

    def names(self, node, ctx: Context, attribute: bool):
        if isinstance(node, t.NcName):
            n = node.name
            ns = n.ns if n.ns is not None else self.prefix(n.prefix, ctx, n.span) if n.prefix else "" if attribute else ctx.default
            return nc.Named(ns, n.local)
        if isinstance(node, t.NcNs):
            ns = node.ns if node.ns is not None else self.prefix(node.prefix, ctx, node.span)
            return nc.NsName(ns, node.but and self.names(node.but, ctx, attribute))
        if isinstance(node, t.NcAny):
            return nc.AnyName(node.but and self.names(node.but, ctx, attribute))
        return nc.Either(self.names(node.a, ctx, attribute), self.names(node.b, ctx, attribute))


def flat(op: str, parts: list):
    """One node for nested parts of the same operator."""
    out = []
    for p in parts:
        out += p[1] if p[0] == op else [p]
    return (op, tuple(out))


def compile_schema(path: str, loader: Loader, syntax: str = "auto", compat: bool = False, restrict: bool = False) -> CompiledSchema:
    """restrict: a schema that breaks a rule of treegrammar.plans.restrictions is an error too."""
    schema = Compiler(loader, syntax, compat).compile(path)
    if restrict:
        from treegrammar.plans.restrictions import check

        check(schema)
    return schema


def compile_text(text: str, syntax: str = "auto", compat: bool = False, restrict: bool = False) -> CompiledSchema:
    """A schema in one string."""
    from treegrammar.sources.schemas import Memory

    return compile_schema("schema", Memory(schema=text), syntax, compat, restrict)
