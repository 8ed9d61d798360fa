"""Name classes: sets of element or attribute names, as Python checks and as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Named:
    ns: str
    local: str

    def has(self, ns: str, local: str) -> bool:
        return self.ns == ns and self.local == local

    def column(self, ns: Column, local: Column) -> Column:
        return (F.coalesce(ns, F.lit("")) == self.ns) & (local == self.local)

    def __str__(self):
        return self.local


@dataclass(frozen=True)
class NsName:
    ns: str
    but: object = None

    def has(self, ns: str, local: str) -> bool:
        return self.ns == ns and not (self.but and self.but.has(ns, local))

    def column(self, ns: Column, local: Column) -> Column:
        inside = F.coalesce(ns, F.lit("")) == self.ns
        return inside & ~self.but.column(ns, local) if self.but else inside

    def __str__(self):
        return f"{{{self.ns}}}*" + (f" - ({self.but})" if self.but else "")


@dataclass(frozen=True)
class AnyName:
    but: object = None

    def has(self, ns: str, local: str) -> bool:
        return not (self.but and self.but.has(ns, local))

    def column(self, ns: Column, local: Column) -> Column:
        return ~self.but.column(ns, local) if self.but else F.lit(True)

    def __str__(self):
        return "*" + (f" - ({self.but})" if self.but else "")


@dataclass(frozen=True)
class Either:
    a: object
    b: object

    def has(self, ns: str, local: str) -> bool:
        return self.a.has(ns, local) or self.b.has(ns, local)

    def column(self, ns: Column, local: Column) -> Column:
        return self.a.column(ns, local) | self.b.column(ns, local)

    def __str__(self):
        return f"{self.a} | {self.b}"


def witnesses(names) -> set[tuple[str, str]]:
    """Names such that two classes meet if they meet in one of these: those that occur in the class, and strangers in place of its wildcards."""
    if isinstance(names, Named):
        return {(names.ns, names.local)}
    if isinstance(names, NsName):
        return {(names.ns, "\0")} | (witnesses(names.but) if names.but else set())
    if isinstance(names, AnyName):
        return {("\0", "\0")} | (witnesses(names.but) if names.but else set())
    return witnesses(names.a) | witnesses(names.b)


def overlap(a, b) -> bool:
    """Do two classes have a name in common?"""
    return any(a.has(*w) and b.has(*w) for w in witnesses(a) | witnesses(b))


def endless(names) -> bool:
    """Does the class hold names without end?"""
    return isinstance(names, (NsName, AnyName)) or isinstance(names, Either) and (endless(names.a) or endless(names.b))
