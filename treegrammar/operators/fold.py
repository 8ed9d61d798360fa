"""An element's content as a deterministic automaton that Spark folds over arrays of child names: no Python on the executors.

The content's derivatives are taken ahead, for every name that a child pattern can take and one that none takes, until no new
state comes up.  The states and steps are a literal array; `aggregate` walks it, one look-up a child.

Which schemas: the root's children must hold nothing that the fold can't see (each takes an empty element without attributes), and
the root has no attributes and no text; otherwise, and beyond `most` states, it is a ValueError.  States of interleaves are as many as
their counts multiply to; operators.tree counts those without states.

Defined results: a null array is no document (null); null names are names that no pattern takes; an empty array is a root without children.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from treegrammar.functions.names import Named
from treegrammar.operators.pool import Pool
from treegrammar.plans.model import CompiledSchema

STATES = 50_000
OTHER = "\0"  # a name that no pattern names


@dataclass
class Automaton:
    names: list[str]  # child names; what is none of them is one more symbol, the last
    steps: list[int]  # state * symbols + symbol -> state
    accepting: list[bool]

    def symbols(self) -> int:
        return len(self.names) + 1

    def accepts(self, children: list[str]) -> bool:
        state = 0
        for c in children:
            state = self.steps[state * self.symbols() + (self.names.index(c) if c in self.names else len(self.names))]
        return self.accepting[state]


def named(pool: Pool, p: int, found: set[str], seen: set[int]) -> None:
    """The local names of the elements that a pattern holds."""
    if p in seen:
        return
    seen.add(p)
    node = pool.nodes[p]
    if node[0] == "element":
        stack = [node[1]]
        while stack:
            n = stack.pop()
            if isinstance(n, Named):
                found.add(n.local)
            stack += [x for x in (getattr(n, "a", None), getattr(n, "b", None), getattr(n, "but", None)) if x is not None]
    elif node[0] in ("attribute", "data", "value", "data_except", "list", "text"):
        raise ValueError(f"{node[0]} in the content is not seen by a fold over children")
    elif node[0] == "choice":
        for q in node[1]:
            named(pool, q, found, seen)
    else:
        for q in node[1:]:
            named(pool, q, found, seen)


def automaton(schema: CompiledSchema, root: str, ns: str = "", most: int = STATES) -> Automaton:
    """The automaton of the content of the root element of this name."""
    pool = Pool(schema)
    opened = pool.open(pool.start, ns, root)
    if opened == pool.NONE:
        raise ValueError(f"{root} is no root of the schema")
    found: set[str] = set()
    for p in pool.nodes[opened][1] if pool.nodes[opened][0] == "choice" else (opened,):
        named(pool, pool.nodes[p][1], found, set())
    begin = pool.close(opened)
    names = sorted(found)
    number, states, steps = {begin: 0}, [begin], []
    at = 0
    while at < len(states):
        for name in [*names, OTHER]:
            child = pool.open(states[at], ns, name)
            after = pool.end(pool.leaf(pool.close(child), ""))
            if child != pool.NONE and after == pool.NONE:
                raise ValueError(f"an empty {name} does not fill its pattern")
            if after not in number:
                if len(states) >= most:
                    raise ValueError(f"more than {most} states")
                number[after] = len(states)
                states.append(after)
            steps.append(number[after])
        at += 1
    accepting = [pool.nullable[pool.end(s)] or pool.nullable[pool.end(pool.leaf(s, ""))] for s in states]
    return Automaton(names, steps, accepting)


def fold_valid(children: Column, a: Automaton) -> Column:
    """Is an array of child names, in order, the content of the automaton's element?"""
    k = a.symbols()

    def bound(value: Column, body) -> Column:
        """body of a literal that the plan holds once."""
        return F.element_at(F.transform(F.array(value), body), 1)

    numbers = lambda xs: F.split(F.lit(" ".join(map(str, xs))), " ").cast("array<int>")
    names = F.array(*(F.lit(n) for n in a.names)).cast("array<string>")
    symbol = lambda c: F.when(F.coalesce(F.array_contains(names, c), F.lit(False)), F.array_position(names, c).cast("int") - 1).otherwise(k - 1)
    word = F.transform(children, symbol)
    state = bound(numbers(a.steps), lambda steps: F.aggregate(word, F.lit(0), lambda s, x: F.get(steps, s * k + x)))
    return F.get(numbers(map(int, a.accepting)), state) == 1
