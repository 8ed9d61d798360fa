"""Documents as tables of nodes and attributes, validated by joins and aggregates: no XML text, no Python on the executors.

A node is a row (doc, node, parent, pos, ns, local, text): its own key within the document, its parent's (null for the root),
a column that orders siblings, its name, and the text it holds.  An attribute is a row (doc, node, ns, local, value).

A schema becomes a deterministic tree grammar: every element pattern is a type, and a child's type follows from its parent's
type and its own name.  Nodes are typed from the root down, a level to a join, and written with their types in the shared folder.  Then five things are checked, each a relation of
faulty rows (faults()):

- element-start: a node whose name has no type below its parent;
- element-close: children that do not make up their parent's content.  Interleaves, and all other contents in which only counts
  matter, are counted (`count_if` between a least and a most, summed where the rows are read); other contents are one `rlike` over the
  children's symbols in order, for which the children of one element come together in one row;
- text: text that is no value of the type, or that stands where only elements may;
- attribute: an attribute that its element can't have, or whose value is none of its type's;
- element-open-end: a required attribute (rows of element and name) that is not among the present ones, by an anti-join.

Where only numbers of faults are asked for (fault_counts(), validate_tree()), and names alone tell types apart, nothing is joined: a node goes to its own
key and to its parent's, an attribute to its owner's, and one aggregation of fixed width counts the faults of every element (tally()).  Documents whose nodes
are not where their names say (misplaced, orphans, repeated) are in doubt, and only they are typed level by level.

Which schemas: refused with ValueError is one where two element patterns of one content take the same name but differ, where an
attribute stands in a choice with elements, text or other attributes, where a list or a QName value is wanted, or where an interleave's parts are
ordered within themselves; validate() takes those.

Defined results: a document with no root or several is not valid (kind document); null text is empty text, a null namespace is none;
repeated rows of a node are taken as nodes of their own and their document is judged as such; a node whose parent is no row of its document is a fault (kind
orphan); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treegrammar.functions.datatypes import Datatype, Value
from treegrammar.functions.names import overlap
from treegrammar.functions.text import is_whitespace_column, normalize_ws
from treegrammar.plans.model import CompiledSchema
from treegrammar.sources.tables import cut, forget

NODE = ["doc", "node", "parent", "pos", "ns", "local", "text"]
FAULTS = "kind string, ns string, local string"
STRANGE = -1  # the type of a node that has none


@dataclass
class Attribute:
    names: object
    value: tuple  # pattern of its value
    least: int  # how many there must be
    most: int | None


@dataclass
class Count:
    """How many children of these types there may be."""

    types: frozenset[int]
    least: int
    most: int | None


@dataclass
class Type:
    names: object
    source: tuple
    attributes: list[Attribute] = field(default_factory=list)
    children: dict[int, object] = field(default_factory=dict)  # type -> name class
    counts: list[Count] | None = None
    regex: str | None = None
    parts: list[Count] | None = None  # the same, if it is counts of classes that follow one another
    text: tuple | None = None  # pattern of its text; None: only blanks
    mixed: bool = False


class TreeGrammar:
    """The types of a schema; types[0] stands above the root."""

    def __init__(self, schema: CompiledSchema):
        self.schema = schema
        self.types: list[Type] = [Type(None, ())]
        self.known: dict[tuple, int] = {}
        start = self.expand(schema.rules[schema.start])
        self.fill(0, start)
        at = 1
        while at < len(self.types):
            self.fill(at, self.expand(self.types[at].source))
            at += 1

    # ---- patterns

    def expand(self, p: tuple) -> tuple:
        """p with its references followed down to elements."""
        if p[0] == "ref":
            return self.expand(self.schema.rules[p[1]])
        if p[0] in ("group", "interleave", "choice"):
            return (p[0], tuple(self.expand(q) for q in p[1]))
        if p[0] in ("one_or_more", "list"):
            return (p[0], self.expand(p[1]))
        if p[0] == "attribute":
            return ("attribute", p[1], self.expand(p[2]))
        if p[0] == "data_except":
            return (p[0], p[1], self.expand(p[2]))
        return p

    def holds(self, p: tuple, kind: str) -> bool:
        if p[0] == kind:
            return True
        if p[0] in ("group", "interleave", "choice"):
            return any(self.holds(q, kind) for q in p[1])
        return p[0] == "one_or_more" and self.holds(p[1], kind)

    def fill(self, at: int, p: tuple) -> None:
        t = self.types[at]
        rest = self.without_attributes(p, t.attributes)
        for i, a in enumerate(t.attributes):
            for b in t.attributes[:i]:
                if overlap(a.names, b.names):
                    raise ValueError("two attributes of one element take the same name")
        if not self.holds(rest, "element"):
            if rest == ("text",) or rest[0] == "interleave" and all(q in (("text",), ("empty",)) for q in rest[1]):
                t.mixed = True
            elif rest != ("empty",):
                check(rest)  # raises where there is no column
                t.text = rest
            t.counts = []
            return
        if rest[0] == "interleave" and ("text",) in rest[1]:
            t.mixed = True
            others = tuple(q for q in rest[1] if q != ("text",))
            rest = others[0] if len(others) == 1 else ("interleave", others)
        self.find(rest, t)
        try:
            t.counts = merged(self.counted(rest))
        except ValueError:
            t.regex = self.word(rest)
            try:
                t.parts = self.sequence(rest)
            except ValueError:
                t.parts = None

    def without_attributes(self, p: tuple, found: list[Attribute]) -> tuple:
        """What is left of p; its attributes go to found."""
        if not self.holds(p, "attribute"):
            return p
        if p[0] == "attribute":
            found.append(Attribute(p[1], p[2], 1, 1))
            return ("empty",)
        if p[0] in ("group", "interleave"):
            left = tuple(q for q in (self.without_attributes(q, found) for q in p[1]) if q != ("empty",))
            return left[0] if len(left) == 1 else (p[0], left) if left else ("empty",)
        if p[0] == "choice" and set(p[1]) - {("empty",)} and len(set(p[1]) - {("empty",)}) == 1:
            (q,) = set(p[1]) - {("empty",)}
            inner: list[Attribute] = []
            if self.without_attributes(q, inner) == ("empty",) and len(inner) == 1:
                found.append(Attribute(inner[0].names, inner[0].value, 0, inner[0].most))
                return ("empty",)
        if p[0] == "one_or_more" and p[1][0] == "attribute":
            found.append(Attribute(p[1][1], p[1][2], 1, None))
            return ("empty",)
        raise ValueError("attributes in a choice need the automaton")

    def number(self, element: tuple) -> int:
        key = (element[1], repr(element[2]))
        if key not in self.known:
            self.known[key] = len(self.types)
            self.types.append(Type(element[1], element[2]))
        return self.known[key]

    def find(self, p: tuple, t: Type) -> None:
        """Takes the elements of p as children of t."""
        if p[0] == "element":
            n = self.number(p)
            for other, names in t.children.items():
                if other != n and overlap(names, p[1]):
                    raise ValueError(f"a child {p[1]} may be of two types")
            t.children[n] = p[1]
        elif p[0] in ("group", "interleave", "choice"):
            for q in p[1]:
                self.find(q, t)
        elif p[0] == "one_or_more":
            self.find(p[1], t)
        elif p[0] not in ("empty", "not_allowed"):
            raise ValueError(f"{p[0]} beside elements needs the automaton")

    def word(self, p: tuple) -> str:
        """A regular expression over the children's symbols."""
        if p[0] == "empty":
            return ""
        if p[0] == "not_allowed":
            return "[^\\s\\S]"
        if p[0] == "element":
            return symbol(self.number(p))
        if p[0] == "group":
            return "".join(map(self.word, p[1]))
        if p[0] == "choice":
            return "(?:" + "|".join(map(self.word, p[1])) + ")"
        if p[0] == "one_or_more":
            return f"(?:{self.word(p[1])})+"
        raise ValueError("parts of an interleave must not be ordered within themselves")

    def sequence(self, p: tuple) -> list[Count]:
        """Counts of classes without common types that follow one another.  ValueError for all other contents."""
        if p[0] != "group":
            counts = merged(self.counted(p))
            if len(counts) > 1:
                raise ValueError("in any order")
            return counts
        out: list[Count] = []
        for c in (c for q in p[1] for c in self.sequence(q)):
            out = out[:-1] + merged([out[-1], c]) if out and out[-1].types == c.types else [*out, c]
        for i, c in enumerate(out):
            for b in out[:i]:  # siblings of one pos are ordered by type, which must be the classes' order or its reverse
                if b.types & c.types or not (max(b.types) < min(c.types) or min(b.types) > max(c.types)):
                    raise ValueError("classes overlap")
        return out

    def names_tell(self) -> bool:
        """Whether a node's name alone says its type, if it has one at all, and types go down a bounded way."""
        types = self.types[1:]
        return depth_of(self) is not None and not any(overlap(a.names, b.names) for i, a in enumerate(types) for b in types[:i])

    def counted(self, p: tuple) -> list[Count]:
        """The counting normal form: p takes every word with these counts, in any order.  ValueError if order matters."""
        if p[0] == "empty":
            return []
        if p[0] == "element":
            return [Count(frozenset({self.number(p)}), 1, 1)]
        if p[0] == "interleave":
            return [c for q in p[1] for c in self.counted(q)]
        if p[0] == "group":
            return one_class([c for q in p[1] for c in self.counted(q)])
        if p[0] == "one_or_more":
            inner = self.counted(p[1])
            if len(inner) > 1 and all(c.least == 0 and c.most is None for c in inner):
                return inner
            for c in (inner := one_class(inner)):
                if c.most == 0 or c.least > 1 and c.most is not None and c.most < 2 * c.least - 1:
                    raise ValueError("only some multiples")
            return [Count(c.types, c.least, None) for c in inner]
        if p[0] == "choice":
            return either([self.counted(q) for q in p[1] if q != ("not_allowed",)])
        raise ValueError(p[0])


def symbol(n: int) -> str:
    """A type's letter."""
    return chr(0x4E00 + n)


def one_class(counts: list[Count]) -> list[Count]:
    """Counts of things that stand one after another: in order they are counted only if all are of one class."""
    if len({c.types for c in counts}) > 1:
        raise ValueError("order matters")
    return merged(counts)


def merged(counts: list[Count]) -> list[Count]:
    """Counts of a class summed up. Classes that overlap can't be told apart by counts."""
    out: dict[frozenset[int], Count] = {}
    for c in counts:
        o = out.get(c.types)
        out[c.types] = c if o is None else Count(c.types, o.least + c.least, None if None in (o.most, c.most) else o.most + c.most)
    classes = list(out)
    if any(a & b for i, a in enumerate(classes) for b in classes[:i]):
        raise ValueError("classes overlap")
    return list(out.values())


def either(ways: list[list[Count]]) -> list[Count]:
    """The counts of a choice."""
    some = [w for w in ways if w]
    empty = len(some) < len(ways)
    if not some:
        return []
    if len(some) == 1 and len(some[0]) > 1:
        if not empty or all(c.least == 0 for c in some[0]):
            return some[0]
        raise ValueError("all or nothing")
    if any(len(w) > 1 for w in some):
        raise ValueError("a choice of several counts")
    flat = [w[0] for w in some]
    if all((c.least, c.most) == (1, 1) for c in flat):
        types = [t for c in flat for t in c.types]
        if len(set(types)) < len(types) and len({c.types for c in flat}) > 1:
            raise ValueError("classes overlap")
        flat = [Count(frozenset(types), 1, 1)]
    if len({c.types for c in flat}) > 1:
        raise ValueError("a choice of several classes")
    spans = sorted([(c.least, c.most) for c in flat] + [(0, 0)] * empty, key=lambda s: (s[0], s[1] is None, s[1] or 0))
    low, high = spans[0]
    for a, b in spans[1:]:
        if high is not None and a > high + 1:
            raise ValueError("a gap")
        high = None if None in (high, b) else max(high, b)
    return [Count(flat[0].types, low, high)]


def check(p: tuple):
    """(column, the same with blanks collapsed if it is at hand) -> column: whether a text is a value of p. ValueError where no column says so."""
    kind = p[0]
    if kind == "text" or p == ("one_or_more", ("text",)):
        return lambda c, normal=None: F.lit(True)
    if kind in ("empty", "not_allowed"):
        return lambda c, normal=None: is_whitespace_column(c) if kind == "empty" else F.lit(False)
    if kind == "choice":
        parts = [check(q) for q in p[1]]
        return lambda c, normal=None: reduce(lambda a, b: a | b, [f(c, normal) for f in parts])
    if kind == "data" or kind == "value":
        if getattr(p[1], "name", "") == "QName":
            raise ValueError("QName values need the prefixes in scope")
        return (lambda c, normal=None: p[1].column(c, normal=normal)) if isinstance(p[1], (Datatype, Value)) else lambda c, normal=None: p[1].column(c)
    if kind == "data_except":
        value, without = check(("data", p[1])), check(p[2])
        return lambda c, normal=None: value(c, normal) & ~without(c, normal)
    raise ValueError(f"{kind} as text needs the automaton")


def by_type(of: Column, cases: dict[int, Column], otherwise: Column) -> Column:
    """The case of a type."""
    out = otherwise
    for n, c in cases.items():
        out = F.when(of == n, c).otherwise(out)
    return out


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def merging(rows: DataFrame) -> DataFrame:
    """rows as a side of a sort-merge join: node tables compress so well that Spark would take them for small and send them through the driver."""
    return rows.hint("merge")


def typed(nodes: DataFrame, grammar: TreeGrammar) -> DataFrame:
    """NODE columns with type and above (the parent's type); nodes below a node without type have none and are left out."""
    spark = nodes.sparkSession
    nodes = nodes.select(*NODE)

    def of(above: Column) -> Column:
        cases = {}
        for n, t in enumerate(grammar.types):
            if t.children:
                cases[n] = F.coalesce(*(F.when(names.column(F.col("ns"), F.col("local")), F.lit(c)) for c, names in t.children.items()), F.lit(STRANGE))
        return by_type(above, cases, F.lit(STRANGE))

    level = nodes.where(F.col("parent").isNull()).withColumn("above", F.lit(0))
    level = level.withColumn("type", of(F.col("above")))
    inner = nodes.where(F.col("parent").isNotNull())
    levels, written = [level], []
    depth = depth_of(grammar)
    while depth is None or len(levels) <= depth:
        over = levels[-1].where(F.col("type") != STRANGE).select(F.col("doc").alias("_doc"), F.col("node").alias("_node"), F.col("type").alias("above"))
        below = inner.join(merging(over), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("parent") == F.col("_node"))).drop("_doc", "_node")
        below = below.withColumn("type", of(F.col("above")))
        if depth is None:  # a recursive grammar: as deep as the documents go
            below = cut(spark, below, "nodes")
            written.append(below)
            if below.isEmpty():
                forget(below)
                break
        levels.append(below)
    return reduce(DataFrame.unionByName, levels)


def depth_of(grammar: TreeGrammar) -> int | None:
    """Levels of nodes below the root that a document may have, one more to find strange ones; None if there is no end to them."""
    state: dict[int, int | None] = {}

    def height(n: int) -> int | None:
        if n in state:
            return state[n]  # None while it is looked at: it holds itself
        state[n] = None
        below = [height(c) for c in grammar.types[n].children]
        state[n] = None if None in below else 1 + max(below, default=0)
        return state[n]

    return height(0)


def faults(nodes: DataFrame, attributes: DataFrame | None, schema: CompiledSchema | TreeGrammar) -> DataFrame:
    """(doc, node, kind, ns, local): every fault of every document.  ns and local are the element's, or the attribute's for attribute and element-open-end."""
    grammar = schema if isinstance(schema, TreeGrammar) else TreeGrammar(schema)
    known = cut(nodes.sparkSession, typed(nodes, grammar), "typed-nodes")  # every check reads it
    element = [F.col("ns"), F.col("local")]

    def fault(rows: DataFrame, kind: str, ns: Column | None = None, local: Column | None = None) -> DataFrame:
        return rows.select("doc", F.col("node").cast("string").alias("node"), F.lit(kind).alias("kind"), (element[0] if ns is None else ns).alias("ns"), (element[1] if local is None else local).alias("local"))

    of = F.col("type")
    good = known.where(of != STRANGE)
    found = [fault(known.where(of == STRANGE), "element-start")]
    # text
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = {n: check(t.text)(text) if t.text else F.lit(True) if t.mixed else is_whitespace_column(text) for n, t in enumerate(grammar.types) if n}
    found.append(fault(good.where(~by_type(of, said, F.lit(True))), "text"))
    # children
    found.append(fault(unfit(good, grammar), "element-close"))
    # attributes
    if attributes is None:
        attributes = nodes.select("doc", "node", F.lit(None).cast("string").alias("ns"), F.lit(None).cast("string").alias("local"), F.lit(None).cast("string").alias("value")).limit(0)
    owners = good.select(F.col("doc").alias("_doc"), F.col("node").alias("_node"), "type")
    present = attributes.select("doc", "node", "ns", "local", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))
    present = present.join(merging(owners), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("node") == F.col("_node"))).drop("_doc", "_node")
    fits = {n: any_of([a.names.column(*element) & value_of(a)(F.col("value")) for a in t.attributes]) for n, t in enumerate(grammar.types) if n and t.attributes}
    found.append(fault(present.where(~by_type(of, fits, F.lit(False))), "attribute"))
    found.append(missing(good, present, grammar))
    # the tree itself
    roots = nodes.groupBy("doc").agg(F.count_if(F.col("parent").isNull()).alias("n")).where("n <> 1")
    found.append(roots.select("doc", F.lit(None).cast("string").alias("node"), F.lit("document").alias("kind"), F.lit(None).cast("string").alias("ns"), F.lit(None).cast("string").alias("local")))
    keys = nodes.select(F.col("doc").alias("_doc"), F.col("node").alias("_node"))
    orphans = nodes.where(F.col("parent").isNotNull()).join(merging(keys), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("parent") == F.col("_node")), "left_anti")
    found.append(fault(orphans, "orphan"))
    return reduce(DataFrame.unionByName, found)


def value_of(a: Attribute):
    """As for an element's text: blanks also stand for nothing."""
    return check(a.value)


def unfit(good: DataFrame, grammar: TreeGrammar) -> DataFrame:
    """The nodes whose typed children do not make up their content."""
    classes = list({c.types: None for t in grammar.types for c in t.counts or ()})
    ordered = [n for n, t in enumerate(grammar.types) if n and t.regex is not None]
    of = F.col("type")
    if not classes and not ordered:
        return good.limit(0)
    letters = F.substring(F.lit("".join(symbol(n) for n in range(len(grammar.types)))), of + 1, F.lit(1))
    aggregates = [F.count_if(of.isin(*sorted(c))).alias(f"_c{i}") for i, c in enumerate(classes)]
    if ordered:
        one = F.when(F.col("above").isin(*ordered), F.struct("pos", letters.alias("s")))
        aggregates.append(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), "").alias("_word"))
    below = good.where(F.col("parent").isNotNull()).groupBy(F.col("doc").alias("_doc"), F.col("parent").alias("_node")).agg(*aggregates)
    # elements whose content may be empty and that have no children need no row of the other side
    rows = good.join(merging(below), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("node") == F.col("_node")), "left")
    fits = {}
    for n, t in enumerate(grammar.types):
        if not n:
            continue
        if t.counts is not None:
            each = []
            for c in t.counts:
                n_of = F.coalesce(F.col(f"_c{classes.index(c.types)}"), F.lit(0))
                each.append(n_of >= c.least if c.most is None else n_of.between(c.least, c.most))
            fits[n] = reduce(lambda a, b: a & b, each, F.lit(True))
        else:
            fits[n] = F.coalesce(F.col("_word"), F.lit("")).rlike(f"\\A(?:{t.regex})\\z")
    return rows.where(~by_type(of, fits, F.lit(True)))


def missing(good: DataFrame, present: DataFrame, grammar: TreeGrammar) -> DataFrame:
    """A row for each required attribute that an element does not have."""
    wanted = [(n, i, a) for n, t in enumerate(grammar.types) for i, a in enumerate(t.attributes) if n and a.least]
    out = ["doc", F.col("node").cast("string").alias("node"), F.lit("element-open-end").alias("kind"), "ns", "local"]
    if not wanted:
        return good.limit(0).select(*out)
    number = {id(a): k for k, (_, _, a) in enumerate(wanted)}
    per_type = {n: F.array(*(F.lit(number[id(a)]) for m, _, a in wanted if m == n)) for n in {n for n, _, _ in wanted}}
    required = good.select("doc", "node", F.explode(by_type(F.col("type"), per_type, F.array().cast("array<int>"))).alias("want"))
    had = by_type(F.col("type"), {n: F.coalesce(*(F.when(a.names.column(F.col("ns"), F.col("local")), F.lit(number[id(a)])) for m, _, a in wanted if m == n)) for n in per_type}, F.lit(None).cast("int"))
    had = present.select(F.col("doc").alias("_doc"), F.col("node").alias("_node"), had.alias("_want"))
    lacks = required.join(merging(had), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("node") == F.col("_node")) & (F.col("want") == F.col("_want")), "left_anti")
    ns = F.element_at(F.array(*(F.lit(getattr(a.names, "ns", None)) for *_, a in wanted)), F.col("want") + 1)
    local = F.element_at(F.array(*(F.lit(str(a.names)) for *_, a in wanted)), F.col("want") + 1)
    return lacks.withColumns({"ns": ns.cast("string"), "local": local}).select(*out)


def identity_faults(nodes: DataFrame, attributes: DataFrame | None, schema: CompiledSchema | TreeGrammar) -> DataFrame:
    """(doc, node, kind, value): ID values that a document has twice (kind duplicate-id, one row a value, no node) and IDREF values that
    are no ID of their document (kind dangling-idref, one row a reference).

    Which attributes and texts are IDs or references follows from the nodes' types; values are compared with blanks collapsed.  Values
    that are no names are none of the type's and are left to faults()."""
    grammar = schema if isinstance(schema, TreeGrammar) else TreeGrammar(schema)
    good = cut(nodes.sparkSession, typed(nodes, grammar).where(F.col("type") != STRANGE), "typed-nodes")
    nothing = F.lit(None).cast("string")

    def use(cases: dict[int, list[tuple[Column, tuple]]], value: Column) -> Column:
        """ID, IDREF or null: cases has for a type (condition, pattern) of its values."""
        out = {}
        for n, of in cases.items():
            ways = [F.when(where & check(q)(value), F.lit(q[1].name)) for where, p in of for q in identities(p)]
            if ways:
                out[n] = F.coalesce(*ways)
        return by_type(F.col("type"), out, nothing)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = {n: [(F.lit(True), t.text)] for n, t in enumerate(grammar.types) if n and t.text}
    found = good.select("doc", F.col("node").cast("string").alias("node"), use(said, text).alias("use"), normalize_ws(text).alias("value"))
    if attributes is not None:
        owners = good.select(F.col("doc").alias("_doc"), F.col("node").alias("_node"), "type")
        value = F.coalesce(F.col("value").cast("string"), F.lit(""))
        cases = {n: [(a.names.column(F.col("ns"), F.col("local")), a.value) for a in t.attributes] for n, t in enumerate(grammar.types) if n}
        present = attributes.select("doc", "node", "ns", "local", "value").join(merging(owners), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("node") == F.col("_node")))
        found = found.union(present.select("doc", F.col("node").cast("string"), use(cases, value), normalize_ws(value)))
    found = found.where("use is not null")
    ids = found.where("use = 'ID'").groupBy("doc", "value").agg(F.count("*").alias("n"))
    twice = ids.where("n > 1").select("doc", nothing.alias("node"), F.lit("duplicate-id").alias("kind"), "value")
    known = ids.select(F.col("doc").alias("_doc"), F.col("value").alias("_value"))
    lost = found.where("use = 'IDREF'").join(merging(known), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("value") == F.col("_value")), "left_anti")
    return twice.union(lost.select("doc", "node", F.lit("dangling-idref"), "value"))


def identities(p: tuple) -> list[tuple]:
    """The ID and IDREF types among the alternatives of a value."""
    if p[0] == "choice":
        return [q for part in p[1] for q in identities(part)]
    return [p] if p[0] == "data" and getattr(p[1], "name", "") in ("ID", "IDREF") else []


KINDS = ["element-start", "text", "element-close", "attribute", "element-open-end", "document"]
SELF, CHILD, OWNED = 0, 1, 2  # what a row says of the key it is counted under
BAD, ROOT = 0, 1  # bits of a node's own row: its text is none of its type's, it has no parent
WIDEST = 62  # counters and bits of a tally


def tally(nodes: DataFrame, attributes: DataFrame | None, grammar: TreeGrammar) -> DataFrame | None:
    """(doc, a number for each of KINDS, doubt): a row for each document.  Where doubt is true the numbers say nothing.  None where an aggregation can't count them.

    In a document without doubt every node whose name has a type is of that type: its parent is there, once, and takes it, so that (as types
    go down a bounded way) a chain of such parents leads to a root.  Nodes without type are faults of a parent that has one, and what is below them is not looked at."""
    types = grammar.types
    if not grammar.names_tell():
        return None
    of_node = {f.name: f.dataType for f in nodes.schema}
    if of_node["parent"] != of_node["node"] or attributes is not None and any(attributes.schema[c].dataType != of_node[c] for c in ("doc", "node")):
        return None
    holders = [n for n, t in enumerate(types) if n and t.attributes]
    wanted = [(n, a) for n in holders for a in types[n].attributes if a.least]
    integral = of_node["pos"].typeName() in ("byte", "short", "integer")
    ordered = [n for n, t in enumerate(types) if n and t.regex is not None]
    placed = {n: types[n].parts for n in ordered if integral and types[n].parts is not None}
    classes = list({c.types: None for parts in placed.values() for c in parts})
    if len(types) + 2 * len(classes) + len(holders) + len(wanted) > WIDEST:
        return None
    element, zero = [F.col("ns"), F.col("local")], F.lit(0).cast("long")
    kind, of, children = F.col("_k"), F.col("type"), range(1, len(types))

    def bit(i: int) -> Column:
        return F.lit(1 << i).cast("long")

    # a row for each thing that is known of a key
    named = F.coalesce(*(F.when(t.names.column(*element), F.lit(n)) for n, t in enumerate(types) if n), F.lit(STRANGE))
    text, normal = F.coalesce("text", F.lit("")), F.coalesce(collapsed(F.col("text")), F.lit(""))
    said = {n: check(t.text)(text, F.col("normal")) if t.text else F.lit(True) if t.mixed else (text == "") | is_whitespace_column(text) for n, t in enumerate(types) if n}
    # checks of all types in one generated method would be too long to be compiled; in a lambda they are not generated
    bad = F.exists(F.array(of), lambda n: ~by_type(n, said, F.lit(True)))
    blank = [n for n in children if not types[n].text]  # may go without text
    bad = F.when(F.col("text").isNull() & of.isin(STRANGE, *blank), F.lit(False)).otherwise(F.coalesce(bad, F.lit(False)))
    known = nodes.select("doc", "node", "parent", F.col("pos").cast("long").alias("pos") if integral else "pos", *element, F.col("text").cast("string").alias("text"))
    known = known.select("doc", "node", "parent", "pos", named.alias("type"), "text", normal.alias("normal"))
    known = known.select("doc", "node", "parent", "pos", "type", F.when(bad, bit(BAD)).otherwise(zero).bitwiseOR(F.when(F.col("parent").isNull(), bit(ROOT)).otherwise(zero)).alias("bits"))
    uses = [(SELF, "node"), (CHILD, "parent")]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("_k"), F.col(c).alias("id")) for k, c in uses))).alias("u")
    rows = known.select("doc", "pos", "type", "bits", each).select("doc", "u.id", "u._k", "pos", "type", "bits")
    rows = rows.where((kind == SELF) | F.col("id").isNotNull())
    if attributes is not None:
        attributes = attributes.where(F.col("node").isNotNull()).select("doc", "node", *element, F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))
        attributes = attributes.withColumn("normal", collapsed(F.col("value")))
        said = [~any_of([a.names.column(*element) & value_of(a)(F.col("value"), F.col("normal")) for a in types[n].attributes]) for n in holders] + [a.names.column(*element) for _, a in wanted]
        bits = reduce(lambda x, y: x.bitwiseOR(y), (F.when(b, bit(i)).otherwise(zero) for i, b in enumerate(said)), zero)
        owned = attributes.select("doc", F.col("node").alias("id"), F.lit(OWNED).alias("_k"), F.lit(None).cast(known.schema["pos"].dataType).alias("pos"), F.lit(0).alias("type"), bits.alias("bits"))
        rows = rows.union(owned)

    # counted under each key
    is_self, is_child, is_owned = kind == SELF, kind == CHILD, kind == OWNED

    def having(i: int) -> Column:
        return F.col("bits").bitwiseAND(bit(i)) != 0

    def many(where: Column) -> Column:
        return F.count(F.when(where, 1))  # count_if would add a column to every row

    sums = [many(is_self).alias("selfs"), F.max(F.when(is_self, of)).alias("type"), many(is_self & having(ROOT)).alias("roots"), many(is_self & having(BAD)).alias("bad")]
    sums += [many(is_child & (of == STRANGE)).alias("_s"), *(many(is_child & (of == n)).alias(f"_n{n}") for n in children)]
    if attributes is not None:
        sums += [many(is_owned).alias("_a"), F.bit_or(F.when(is_owned, F.col("bits"))).alias("_had")]
        sums += [many(is_owned & having(i)).alias(f"_f{n}") for i, n in enumerate(holders)]
    place = F.coalesce(F.col("pos"), F.lit(-(1 << 63))) if integral else F.col("pos")  # null goes first
    for i, c in enumerate(classes):
        here = F.when(is_child & of.isin(*sorted(c)), place)
        sums += [F.min(here).alias(f"_first{i}"), F.max(here).alias(f"_last{i}")]
    gathered = sorted({c for n in ordered if n not in placed for c in types[n].children})
    if gathered:
        letters = F.substring(F.lit("".join(symbol(n) for n in range(len(types)))), of + 1, F.lit(1))
        one = F.when(is_child & of.isin(*gathered), F.struct("pos", letters.alias("s")))
        sums.append(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), "").alias("_word"))
    keys = rows.groupBy("doc", "id").agg(*sums)

    # judged
    def number(of_types) -> Column:
        return reduce(lambda a, b: a + b, (F.col(f"_n{n}") for n in sorted(of_types)), zero)

    def between(c: Count) -> Column:
        return number(c.types) >= c.least if c.most is None else number(c.types).between(c.least, c.most)

    fits, lacks, strange, misplaced = {}, {}, {}, {}
    had = F.lit(0).cast("long") if attributes is None else F.coalesce(F.col("_had"), zero)
    for n in children:
        t = types[n]
        misplaced[n] = number(set(children) - set(t.children)) > 0
        if t.counts is not None:
            fits[n] = reduce(lambda a, b: a & b, map(between, t.counts), F.lit(True))
        elif n in placed:
            parts = t.parts
            fits[n] = reduce(lambda a, b: a & b, map(between, parts), F.lit(True))
            for j, c in enumerate(parts):
                for b in parts[:j]:
                    last, first = F.col(f"_last{classes.index(b.types)}"), F.col(f"_first{classes.index(c.types)}")
                    fits[n] &= F.coalesce(last <= first if max(b.types) < min(c.types) else last < first, F.lit(True))
        else:
            fits[n] = F.coalesce(F.col("_word"), F.lit("")).rlike(f"\\A(?:{t.regex})\\z")
        if attributes is not None:
            strange[n] = F.col(f"_f{n}") if n in holders else F.col("_a")
        lacks[n] = reduce(lambda a, b: a + b, (F.when(had.bitwiseAND(bit(len(holders) + i)) == 0, 1).otherwise(0).cast("long") for i, (m, _) in enumerate(wanted) if m == n), zero)
    has_type = of != STRANGE
    judged = {
        "element-start": F.when(has_type, F.col("_s")).when(of == STRANGE, F.col("roots")).otherwise(zero),
        "text": F.when(has_type, F.col("bad")).otherwise(zero),
        "element-close": F.when(has_type & ~by_type(of, fits, F.lit(True)), 1).otherwise(0).cast("long"),
        "attribute": by_type(of, strange, zero),
        "element-open-end": by_type(of, lacks, zero),
    }
    below = number(children)
    repeated, orphans, under = F.col("selfs") > 1, (F.col("selfs") == 0) & (below + F.col("_s") > 0), (of == STRANGE) & (below > 0)
    no_root = has_type & (F.col("roots") > 0) & by_type(of, {n: F.lit(False) for n in types[0].children}, F.lit(True))
    doubt = repeated | orphans | under | no_root | by_type(of, misplaced, F.lit(False))
    judged_keys = keys.select("doc", "selfs", "roots", F.coalesce(doubt, F.lit(False)).alias("doubt"), *(c.alias(k) for k, c in judged.items()))
    docs = judged_keys.groupBy("doc").agg(F.sum("selfs").alias("selfs"), F.sum("roots").alias("roots"), many(F.col("doubt")).alias("doubts"), *(F.sum(F.col(f"`{k}`")).alias(k) for k in judged)).where("selfs > 0")
    return docs.select("doc", *(F.col(f"`{k}`") for k in judged), F.when(F.col("roots") != 1, 1).otherwise(0).cast("long").alias("document"), (F.col("doubts") > 0).alias("doubt"))


def collapsed(c: Column) -> Column:
    """normalize_ws(), which looks at texts with a blank only."""
    return F.when(any_of([c.contains(b) for b in " \t\n\f\r"]), normalize_ws(c)).otherwise(c)


def of_docs(rows: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The rows of these documents, written."""
    docs = docs.select(F.col("doc").alias("_doc"))
    return cut(rows.sparkSession, rows.join(merging(docs), F.col("doc").eqNullSafe(F.col("_doc")), "left_semi"), name)


def counted(nodes: DataFrame, attributes: DataFrame | None, grammar: TreeGrammar) -> tuple[DataFrame, DataFrame] | None:
    """tally(), written, and (doc, kind, faults) of its documents in doubt, which are typed level by level.  None if there is no tally."""
    found = tally(nodes, attributes, grammar)
    if found is None:
        return None
    found = cut(nodes.sparkSession, found, "tally")
    again = found.where("doubt")
    if again.isEmpty():
        return found, again.select("doc", F.lit(None).cast("string").alias("kind"), F.lit(0).cast("long").alias("faults"))
    some = None if attributes is None else of_docs(attributes.select("doc", "node", "ns", "local", "value"), again, "attributes")
    return found, by_kind(faults(of_docs(nodes.select(*NODE), again, "nodes"), some, grammar))


def by_kind(found: DataFrame) -> DataFrame:
    return found.groupBy("doc", "kind").agg(F.count("*").alias("faults"))


def fault_counts(nodes: DataFrame, attributes: DataFrame | None, schema: CompiledSchema | TreeGrammar) -> DataFrame:
    """(doc, kind, faults): how many faults of each kind a document has, as far as it has any."""
    grammar = schema if isinstance(schema, TreeGrammar) else TreeGrammar(schema)
    known = counted(nodes, attributes, grammar)
    if known is None:
        return by_kind(faults(nodes, attributes, grammar))
    found, exact = known
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").alias("faults")) for k in KINDS)))
    return found.where("not doubt").select("doc", each).where("faults > 0").union(exact)


def validate_tree(nodes: DataFrame, attributes: DataFrame | None, schema: CompiledSchema | TreeGrammar, doc: str = "doc") -> DataFrame:
    """(doc, valid, faults): every document of the node table and how many faults it has."""
    grammar = schema if isinstance(schema, TreeGrammar) else TreeGrammar(schema)
    known = counted(nodes, attributes, grammar)
    if known is None:
        docs, bad = nodes.select("doc").distinct(), by_kind(faults(nodes, attributes, grammar))
    else:
        docs, bad = known[0].where("doubt").select("doc"), known[1]
    bad = bad.groupBy(F.col("doc").alias("_doc")).agg(F.sum("faults").alias("faults"))
    rows = docs.join(merging(bad), F.col("doc").eqNullSafe(F.col("_doc")), "left").select("doc", F.coalesce("faults", F.lit(0)).cast("long").alias("faults"))
    if known is not None:
        rows = known[0].where("not doubt").select("doc", reduce(lambda a, b: a + b, (F.col(f"`{k}`") for k in KINDS)).alias("faults")).union(rows)
    return rows.select(F.col("doc").alias(doc), (F.col("faults") == 0).alias("valid"), "faults")
