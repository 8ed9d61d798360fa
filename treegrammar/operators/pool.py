"""Patterns as small numbers, and their derivatives.

Every pattern is interned, choices are sorted sets, and each derivative is computed once, so that validating documents
fills in a deterministic automaton as far as they need it.  A state is one number; what follows the open elements stands in
its ``after`` nodes.
"""

from __future__ import annotations

import sys

from treegrammar.functions.text import is_whitespace
from treegrammar.plans.model import CompiledSchema

#: What a pool keeps: characters of the texts and attribute values whose derivatives are remembered (of those over LONG only the last), and
#: names; a pool with more patterns than STATES starts anew with the next document.
MEMO, LONG, NAMES, STATES = 16 << 20, 1 << 10, 200_000, 1_000_000

sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))


class Pool:
    def __init__(self, schema: CompiledSchema):
        self.schema = schema
        self.nodes: list[tuple] = []
        self.nullable: list[bool] = []
        self.known: dict[tuple, int] = {}
        self.NONE, self.EMPTY, self.TEXT = self.put(("none",), False), self.put(("empty",), True), self.put(("text",), True)
        self.rules: dict[int, int] = {}
        self.bodies: dict[tuple, int] = {}
        self.opened: dict[tuple, int] = {}
        self.closed: dict[int, int] = {}
        self.ended: dict[int, int] = {}
        self.excused: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.texts: dict[tuple, int] = {}
        self.atts: dict[tuple, int] = {}
        self.held = 0  # characters of texts and atts
        self.longs: dict[tuple, int] = {}
        self.last_long: str | None = None
        self.plain: dict[type, object] = {}  # steps over whole tags, for each kind of run
        self.resolve = None  # prefixes in scope, for QName values
        self.start = self.rule(schema.start)

    # ---- construction

    def put(self, node: tuple, nullable: bool) -> int:
        at = self.known.get(node)
        if at is None:
            at = self.known[node] = len(self.nodes)
            self.nodes.append(node)
            self.nullable.append(nullable)
        return at

    def choice(self, *parts: int) -> int:
        out: set[int] = set()
        for p in parts:
            if self.nodes[p][0] == "choice":
                out.update(self.nodes[p][1])
            elif p != self.NONE:
                out.add(p)
        if not out:
            return self.NONE
        if len(out) == 1:
            return out.pop()
        if self.EMPTY in out and any(self.nullable[p] for p in out if p != self.EMPTY):
            out.discard(self.EMPTY)
            if len(out) == 1:
                return out.pop()
        return self.put(("choice", tuple(sorted(out))), any(self.nullable[p] for p in out))

    def pair(self, op: str, a: int, b: int) -> int:
        if self.NONE in (a, b):
            return self.NONE
        if a == self.EMPTY:
            return b
        if b == self.EMPTY:
            return a
        if op == "interleave" and a > b:
            a, b = b, a
        return self.put((op, a, b), self.nullable[a] and self.nullable[b])

    def group(self, a: int, b: int) -> int:
        return self.pair("group", a, b)

    def interleave(self, a: int, b: int) -> int:
        return self.pair("interleave", a, b)

    def more(self, p: int) -> int:
        return p if p in (self.NONE, self.EMPTY, self.TEXT) else self.put(("more", p), self.nullable[p])

    def after(self, a: int, b: int) -> int:
        return self.NONE if self.NONE in (a, b) else self.put(("after", a, b), False)

    def rule(self, n: int) -> int:
        if n not in self.rules:
            self.rules[n] = self.build(self.schema.rules[n])
        return self.rules[n]

    def build(self, p: tuple) -> int:
        kind = p[0]
        if kind == "ref":
            return self.rule(p[1])
        if kind in ("empty", "text", "not_allowed"):
            return {"empty": self.EMPTY, "text": self.TEXT, "not_allowed": self.NONE}[kind]
        if kind == "choice":
            return self.choice(*(self.build(q) for q in p[1]))
        if kind in ("group", "interleave"):
            parts = [self.build(q) for q in p[1]]
            out = parts[-1]
            for q in reversed(parts[:-1]):
                out = self.pair(kind, q, out)
            return out
        if kind == "one_or_more":
            return self.more(self.build(p[1]))
        if kind == "element":  # its content is built when an instance first needs it: rules may recur through it
            return self.put(("element", p[1], p[2]), False)
        if kind == "attribute":
            return self.put(("attribute", p[1], self.build(p[2])), False)
        if kind == "list":
            return self.put(("list", self.build(p[1])), False)
        if kind in ("data", "value"):
            return self.put((kind, p[1]), False)
        if kind == "data_except":
            return self.put((kind, p[1], self.build(p[2])), False)
        raise TypeError(kind)

    def body(self, source: tuple) -> int:
        if source not in self.bodies:
            self.bodies[source] = self.build(source)
        return self.bodies[source]

    # ---- patterns that outlive a pool

    def exported(self, p: int) -> list[tuple]:
        """The nodes that p is made of, parts first: (op, parts as places in this list, what else the node holds, nullable)."""
        place: dict[int, int] = {}
        out: list[tuple] = []
        stack = [(p, False)]
        while stack:
            q, ready = stack.pop()
            if q in place:
                continue
            node = self.nodes[q]
            parts = node[1] if node[0] == "choice" else [x for x in node[1:] if isinstance(x, int)]
            if not ready:
                stack += [(q, True), *((x, False) for x in parts)]
                continue
            place[q] = len(out)
            rest = () if node[0] == "choice" else tuple(x for x in node[1:] if not isinstance(x, int))
            out.append((node[0], tuple(place[x] for x in parts), rest, self.nullable[q]))
        return out

    def imported(self, nodes: list[tuple]) -> int:
        """The pattern that exported() gave, in this pool, whatever numbers it has here."""
        at: list[int] = []
        for op, parts, rest, nullable in nodes:
            own = [at[x] for x in parts]
            if op == "choice":
                at.append(self.choice(*own))
            elif op in ("group", "interleave"):
                at.append(self.pair(op, *own))
            elif op == "more":
                at.append(self.more(*own))
            elif op == "after":
                at.append(self.after(*own))
            else:
                at.append(self.put((op, *rest, *own), nullable))
        return at[-1]

    # ---- derivatives

    def then(self, p: int, f) -> int:
        """f over what follows each alternative."""
        node = self.nodes[p]
        if node[0] == "after":
            return self.after(node[1], f(node[2]))
        if node[0] == "choice":
            return self.choice(*(self.then(q, f) for q in node[1]))
        return self.NONE

    def remembered(self, memo: dict[tuple, int], key: tuple, size: int, f) -> int:
        """f(*key), from memo unless prefixes matter; of long texts only the last one's are kept."""
        if self.resolve:
            return f(*key)
        if size > LONG:
            if self.last_long is not key[-1]:
                self.longs.clear()
                self.last_long = key[-1]
            if key not in self.longs:
                self.longs[key] = f(*key)
            return self.longs[key]
        out = memo.get(key)
        if out is None:
            if self.held > MEMO:
                self.texts.clear()
                self.atts.clear()
                self.held = 0
            out = memo[key] = f(*key)
            self.held += size + 64
        return out

    def worn(self) -> bool:
        """Has it met so many patterns that a new pool is due?"""
        return len(self.nodes) > STATES

    def open(self, p: int, ns: str, local: str) -> int:
        key = (p, ns, local)
        if len(self.opened) > NAMES:
            self.opened.clear()
        if key not in self.opened:
            self.opened[key] = self._open(p, ns, local)
        return self.opened[key]

    def _open(self, p: int, ns: str, local: str) -> int:
        node = self.nodes[p]
        kind = node[0]
        if kind == "choice":
            return self.choice(*(self.open(q, ns, local) for q in node[1]))
        if kind == "element":
            return self.after(self.body(node[2]), self.EMPTY) if node[1].has(ns, local) else self.NONE
        if kind == "group":
            out = self.then(self.open(node[1], ns, local), lambda x: self.group(x, node[2]))
            return self.choice(out, self.open(node[2], ns, local)) if self.nullable[node[1]] else out
        if kind == "interleave":
            return self.choice(self.then(self.open(node[1], ns, local), lambda x: self.interleave(x, node[2])), self.then(self.open(node[2], ns, local), lambda x: self.interleave(node[1], x)))
        if kind == "more":
            rest = self.choice(p, self.EMPTY)
            return self.then(self.open(node[1], ns, local), lambda x: self.group(x, rest))
        if kind == "after":
            return self.then(self.open(node[1], ns, local), lambda x: self.after(x, node[2]))
        return self.NONE

    def att(self, p: int, ns: str, local: str, value: str | None) -> int:
        """value None: whatever the value may be."""
        if value is None:
            return self._att(p, ns, local, value)
        return self.remembered(self.atts, (p, ns, local, value), len(value), self._att)

    def _att(self, p: int, ns: str, local: str, value: str | None) -> int:
        node = self.nodes[p]
        kind = node[0]
        if kind == "choice":
            return self.choice(*(self.att(q, ns, local, value) for q in node[1]))
        if kind in ("group", "interleave"):
            return self.choice(self.pair(kind, self.att(node[1], ns, local, value), node[2]), self.pair(kind, node[1], self.att(node[2], ns, local, value)))
        if kind == "more":
            return self.group(self.att(node[1], ns, local, value), self.choice(p, self.EMPTY))
        if kind == "after":
            return self.after(self.att(node[1], ns, local, value), node[2])
        if kind == "attribute":
            return self.EMPTY if node[1].has(ns, local) and (value is None or self.matches(node[2], value)) else self.NONE
        return self.NONE

    def matches(self, p: int, value: str) -> bool:
        return (self.nullable[p] and is_whitespace(value)) or self.nullable[self.text(p, value)]

    def close(self, p: int) -> int:
        """After a start tag: attributes that are still wanted are missing."""
        if p not in self.closed:
            node = self.nodes[p]
            kind = node[0]
            if kind == "choice":
                out = self.choice(*(self.close(q) for q in node[1]))
            elif kind in ("group", "interleave"):
                out = self.pair(kind, self.close(node[1]), self.close(node[2]))
            elif kind == "more":
                out = self.more(self.close(node[1]))
            elif kind == "after":
                out = self.after(self.close(node[1]), node[2])
            else:
                out = self.NONE if kind == "attribute" else p
            self.closed[p] = out
        return self.closed[p]

    def text(self, p: int, s: str) -> int:
        return self.remembered(self.texts, (p, s), len(s), self._text)

    def _text(self, p: int, s: str) -> int:
        node = self.nodes[p]
        kind = node[0]
        if kind == "choice":
            return self.choice(*(self.text(q, s) for q in node[1]))
        if kind == "group":
            out = self.group(self.text(node[1], s), node[2])
            return self.choice(out, self.text(node[2], s)) if self.nullable[node[1]] else out
        if kind == "interleave":
            return self.choice(self.interleave(self.text(node[1], s), node[2]), self.interleave(node[1], self.text(node[2], s)))
        if kind == "more":
            return self.group(self.text(node[1], s), self.choice(p, self.EMPTY))
        if kind == "after":
            return self.after(self.text(node[1], s), node[2])
        if kind == "text":
            return p
        if kind == "data":
            return self.EMPTY if node[1].check(s) else self.NONE
        if kind == "value":
            return self.EMPTY if node[1].check(s, self.resolve) else self.NONE
        if kind == "data_except":
            return self.EMPTY if node[1].check(s) and not self.nullable[self.text(node[2], s)] else self.NONE
        if kind == "list":
            q = node[1]
            for item in s.split():
                q = self.text(q, item)
            return self.EMPTY if self.nullable[q] else self.NONE
        return self.NONE

    def leaf(self, p: int, s: str) -> int:
        """The whole content of an element without children; blanks may also stand for nothing."""
        out = self.text(p, s)
        return self.choice(p, out) if is_whitespace(s) else out

    def end(self, p: int) -> int:
        if p not in self.ended:
            node = self.nodes[p]
            if node[0] == "choice":
                out = self.choice(*(self.end(q) for q in node[1]))
            else:
                out = node[2] if node[0] == "after" and self.nullable[node[1]] else self.NONE
            self.ended[p] = out
        return self.ended[p]

    # ---- recovery: what would stand if a fault had not been made

    def excuse(self, p: int) -> int:
        """After a start tag whose attributes are not all there: as if they were."""
        if p not in self.excused:
            node = self.nodes[p]
            kind = node[0]
            if kind == "choice":
                out = self.choice(*(self.excuse(q) for q in node[1]))
            elif kind in ("group", "interleave"):
                out = self.pair(kind, self.excuse(node[1]), self.excuse(node[2]))
            elif kind == "more":
                out = self.more(self.excuse(node[1]))
            elif kind == "after":
                out = self.after(self.excuse(node[1]), node[2])
            else:
                out = self.EMPTY if kind == "attribute" else p
            self.excused[p] = out
        return self.excused[p]

    def leave(self, p: int) -> int:
        """After an element that ends too early: as if it were whole."""
        if p not in self.left:
            node = self.nodes[p]
            self.left[p] = self.choice(*(self.leave(q) for q in node[1])) if node[0] == "choice" else node[2] if node[0] == "after" else self.NONE
        return self.left[p]

    # ---- what may come next

    def heads(self, p: int) -> tuple[set[str], set[str], bool]:
        """Elements and attributes (as texts) that may come next, and whether text may."""
        elements, attributes, text, seen, stack = set(), set(), False, set(), [p]
        while stack:
            p = stack.pop()
            if p in seen:
                continue
            seen.add(p)
            node = self.nodes[p]
            kind = node[0]
            if kind == "choice":
                stack += node[1]
            elif kind == "group":
                stack += node[1:] if self.nullable[node[1]] or self.close(node[1]) == self.NONE else node[1:2]
            elif kind == "interleave":
                stack += node[1:]
            elif kind in ("more", "after"):
                stack.append(node[1])
            elif kind == "element":
                elements.add(str(node[1]))
            elif kind == "attribute":
                attributes.add(str(node[1]))
            elif kind not in ("empty", "none"):
                text = True
        return elements, attributes, text

    def expected(self, p: int, most: int = 4) -> str:
        elements, attributes, text = self.heads(p)
        out = []
        for label, found in (("Attribute", attributes), ("Element", elements)):
            if found:
                names = sorted(found)
                more = f" or one of {len(names) - most} more" if len(names) > most else ""
                out.append(f"{label} {' '.join(names[:most])}{more}")
        return "; ".join(out + ["text"] * text)

    def rows(self) -> list[tuple]:
        """(pid, op, left, right, nullable, detail) of every pattern met so far."""
        out = []
        for i, node in enumerate(self.nodes):
            kids = list(node[1]) if node[0] == "choice" else [x for x in node[1:] if isinstance(x, int)]
            detail = "" if node[0] == "choice" else str(next((x for x in node[1:] if not isinstance(x, (int, tuple))), ""))
            out.append((i, node[0], kids[0] if kids else None, kids[1] if len(kids) > 1 else None, self.nullable[i], detail))
        return out
