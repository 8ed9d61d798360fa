"""Reader of the compact syntax.

Operators of one level may be mixed without parentheses and nest to the right; repetition marks bind to the nearest
primary.  Annotations are read and dropped.
"""

from __future__ import annotations

import re

from treegrammar.errors import SchemaError
from treegrammar.functions.text import NCNAME
from treegrammar.syntax import tree as t

#: Words that need a backslash to serve as identifiers (fixed values of the syntax).
KEYWORDS = {
    "attribute", "default", "datatypes", "div", "element", "empty", "external", "grammar", "include", "inherit",
    "list", "mixed", "namespace", "notAllowed", "parent", "start", "string", "text", "token",
}
_TOKEN = re.compile(
    rf"""(?P<skip>(?:[ \t\r\n\ufeff]|\#[^\n]*)+)
    |(?P<literal>\"\"\"(?:(?!\"\"\").)*\"\"\"|'''(?:(?!''').)*'''|"[^"\n]*"|'[^'\n]*')
    |(?P<nsname>{NCNAME}:\*)
    |(?P<cname>{NCNAME}:{NCNAME})
    |(?P<quoted>\\{NCNAME})
    |(?P<word>{NCNAME})
    |(?P<mark>\|=|&=|>>|[={{}}()\[\],&|?*+~-])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\x\{([0-9a-fA-F]+)\}")


def tokens(text: str, file: str) -> list[tuple[str, str, int, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SchemaError("Parse", f"unexpected {text[at]!r}", file, (at, at + 1))
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m.group(), at, m.end()))
        at = m.end()
    out.append(("end", "", len(text), len(text)))
    return out


class Reader:
    def __init__(self, text: str, file: str):
        self.file, self.at = file, 0
        self.all = tokens(_ESCAPE.sub(lambda m: chr(int(m.group(1), 16)), text), file)

    # ---- tokens

    def kind(self, ahead: int = 0) -> str:
        return self.all[min(self.at + ahead, len(self.all) - 1)][0]

    def word(self, ahead: int = 0) -> str:
        return self.all[min(self.at + ahead, len(self.all) - 1)][1]

    def span(self) -> t.Span:
        return self.all[self.at][2:]

    def is_(self, *words: str) -> bool:
        return self.kind() in ("word", "mark") and self.word() in words

    def take(self, *words: str) -> str | None:
        if self.is_(*words):
            self.at += 1
            return self.all[self.at - 1][1]
        return None

    def need(self, *words: str) -> str:
        got = self.take(*words)
        if got is None:
            self.fail(" or ".join(words))
        return got

    def fail(self, wanted: str):
        raise SchemaError("Parse", f"expected {wanted}, found {self.word() or 'the end'!r}", self.file, self.span())

    def literal(self) -> str:
        parts = []
        while True:
            if self.kind() != "literal":
                self.fail("a literal")
            w = self.word()
            parts.append(w[3:-3] if w[:3] in ('"""', "'''") and len(w) >= 6 else w[1:-1])
            self.at += 1
            if not self.take("~"):
                return "".join(parts)

    def identifier(self, keywords: bool = False) -> str:
        if self.kind() == "quoted":
            self.at += 1
            return self.all[self.at - 1][1][1:]
        if self.kind() != "word" or (self.word() in KEYWORDS and not keywords):
            self.fail("an identifier")
        self.at += 1
        return self.all[self.at - 1][1]

    # ---- annotations

    def brackets(self) -> None:
        """[ ... ] with whatever it holds."""
        deep = 0
        while True:
            if self.kind() == "end":
                self.fail("]")
            deep += self.is_("[") - self.is_("]")
            self.at += 1
            if not deep:
                return

    def annotations(self) -> None:
        while self.is_("["):
            self.brackets()

    def following(self) -> None:
        while self.take(">>"):
            self.at += 1
            self.brackets()

    # ---- schema

    def schema(self) -> t.Schema:
        decls = []
        while (d := self.declaration()) is not None:
            decls.append(d)
        save = self.at
        self.annotations()
        grammar = self.kind() == "end" or self.is_("start", "div", "include") or (self.kind() in ("word", "quoted", "cname") and self.word(1) in ("=", "|=", "&=", "["))
        if grammar:
            self.at = save
            body = t.Grammar(self.content("end"))
        else:
            body = self.pattern()
        if self.kind() != "end":
            self.fail("the end")
        return t.Schema(decls, body)

    def declaration(self):
        save, span = self.at, self.span()
        self.annotations()
        if self.take("namespace"):
            prefix = self.identifier(True)
            self.need("=")
            return t.Namespace(prefix, self.uri(), False, span)
        if self.is_("default") and self.word(1) == "namespace":
            self.at += 2
            prefix = None if self.is_("=") else self.identifier(True)
            self.need("=")
            return t.Namespace(prefix, self.uri(), True, span)
        if self.take("datatypes"):
            prefix = self.identifier(True)
            self.need("=")
            return t.Datatypes(prefix, self.literal(), span)
        self.at = save
        return None

    def uri(self):
        return t.INHERIT if self.take("inherit") else self.literal()

    def content(self, close: str, include: bool = False) -> list:
        out = []
        while not (self.kind() == "end" if close == "end" else self.is_(close)):
            self.annotations()
            span = self.span()
            if self.kind() in ("word", "quoted", "cname") and self.word(1) == "[":  # an annotation element
                self.at += 1
                self.brackets()
            elif self.is_("start") and self.word(1) in ("=", "|=", "&="):
                self.at += 1
                op = self.need("=", "|=", "&=")
                out.append(t.Define("start", op, self.pattern(), span))
            elif self.take("div"):
                self.need("{")
                out.append(t.Div(self.content("}", include)))
                self.need("}")
            elif not include and self.take("include"):
                href, inherit, overrides = self.literal(), self.inherit(), []
                if self.take("{"):
                    overrides = self.content("}", True)
                    self.need("}")
                out.append(t.Include(href, overrides, inherit, None, span))
            else:
                name = self.identifier()
                op = self.need("=", "|=", "&=")
                out.append(t.Define(name, op, self.pattern(), span))
        return out

    def inherit(self) -> str | None:
        if self.take("inherit"):
            self.need("=")
            return self.identifier(True)
        return None

    # ---- patterns

    def pattern(self):
        left = self.repeated()
        if op := self.take(",", "&", "|"):
            return t.Pair(op, left, self.pattern())
        return left

    def repeated(self):
        self.annotations()
        out = self.primary()
        self.following()
        while op := self.take("?", "*", "+"):
            out = t.Repeat(op, out)
            self.following()
        return out

    def braced(self):
        self.need("{")
        out = self.pattern()
        self.need("}")
        return out

    def primary(self):
        span = self.span()
        if self.kind() == "literal":
            return t.Value(None, self.literal(), span)
        if self.kind() == "cname":
            prefix, _, name = self.word().partition(":")
            self.at += 1
            return self.typed(t.TypeName(name, prefix, None, span), span)
        if self.take("("):
            out = self.pattern()
            self.need(")")
            return out
        if self.kind() == "word" and self.word() in KEYWORDS:
            word = self.word()
            self.at += 1
            if word in ("element", "attribute"):
                names = self.name_class()
                if word == "attribute" and self.is_xmlns(names):
                    raise SchemaError("InvalidName", "an attribute can't be named xmlns", self.file, span)
                return (t.Element if word == "element" else t.Attribute)(names, self.braced(), span)
            if word == "list":
                return t.ListOf(self.braced(), span)
            if word == "mixed":
                return t.Mixed(self.braced())
            if word in ("empty", "text", "notAllowed"):
                return {"empty": t.Empty, "text": t.Text, "notAllowed": t.NotAllowed}[word]()
            if word in ("string", "token"):
                return self.typed(t.TypeName(word, None, "", span), span)
            if word == "parent":
                return t.Ref(self.identifier(), span, True)
            if word == "grammar":
                self.need("{")
                out = t.Grammar(self.content("}"))
                self.need("}")
                return out
            if word == "external":
                return t.External(self.literal(), self.inherit(), None, span)
            self.at -= 1
            self.fail("a pattern")
        if self.kind() in ("word", "quoted"):
            return t.Ref(self.identifier(), span)
        self.fail("a pattern")

    def typed(self, type_: t.TypeName, span: t.Span):
        if self.kind() == "literal":
            return t.Value(type_, self.literal(), span)
        params = []
        if self.take("{"):
            while not self.take("}"):
                self.annotations()
                key = self.identifier(True)
                self.need("=")
                params.append((key, self.literal()))
        but = None
        if self.take("-"):
            self.annotations()
            but = self.primary()
        return t.Data(type_, params, but, span)

    # ---- name classes

    @staticmethod
    def is_xmlns(names) -> bool:
        stack = [names]
        while stack:
            n = stack.pop()
            if isinstance(n, t.NcAlt):
                stack += vars(n).values()
            elif isinstance(n, t.NcName) and n.name.local == "xmlns" and not n.name.prefix:
                return True
        return False

    def name_class(self, inside: str = ""):
        """inside: what kind of class (*, or ns:*) this is an exception of."""
        out = self.one_class(inside)
        while self.take("|"):
            out = t.NcAlt(out, self.one_class(inside))
        return out

    def one_class(self, inside: str = ""):
        self.annotations()
        span = self.span()
        if self.take("("):
            out = self.name_class(inside)
            self.need(")")
        elif self.take("*"):
            if inside:
                raise SchemaError("InvalidName", "* can't be excepted", self.file, span)
            out = t.NcAny(self.one_class("*") if self.take("-") else None)
        elif self.kind() == "nsname":
            if inside == "ns":
                raise SchemaError("InvalidName", "a namespace can't be excepted from one", self.file, span)
            prefix = self.word()[:-2]
            self.at += 1
            out = t.NcNs(prefix, self.one_class("ns") if self.take("-") else None, None, span)
        elif self.kind() == "cname":
            prefix, _, local = self.word().partition(":")
            self.at += 1
            out = t.NcName(t.Name(local, prefix, None, span))
        else:
            out = t.NcName(t.Name(self.identifier(True), None, None, span))
        self.following()
        return out


def parse(text: str, file: str = "") -> t.Schema:
    return Reader(text, file).schema()
