"""Datatypes: for each a Python check and a Spark column with the same answer.

A datatype is (library, name, facets).  ``check(value)`` serves the general validator, ``column(c)`` is an ordinary column
expression for whole tables.  A value must match all of a type's patterns (read as XML Schema patterns).  Further libraries are
added with ``register_library``.  In compat mode facets behave as they do in common use of this grammar family (patterns are
searched as they are, the last one alone, digit facets and double bounds have no effect, positiveInteger takes zero); strict mode follows XML Schema.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from typing import NamedTuple, Protocol

import regex

from pyspark.sql import Column
from pyspark.sql import functions as F

from treegrammar.errors import SchemaError
from treegrammar.functions.text import NAME_MORE, NCNAME, normalize_whitespace, normalize_ws

XSD = "http://www.w3.org/2001/XMLSchema-datatypes"
BUILTIN = ""

#: Ranges of the bounded whole-number types (fixed values of XML Schema).
WHOLE = {
    "short": (-(2**15), 2**15 - 1),
    "unsignedShort": (0, 2**16 - 1),
    "int": (-(2**31), 2**31 - 1),
    "unsignedInt": (0, 2**32 - 1),
    "long": (-(2**63), 2**63 - 1),
    "unsignedLong": (0, 2**64 - 1),
    "integer": (None, None),
    "positiveInteger": (0, None),
}
STRINGS = ("string", "normalizedString", "token", "NMTOKEN", "NMTOKENS", "NCName", "ID", "IDREF", "language", "anyURI", "boolean", "date", "dateTime", "duration")
WITH_LENGTH = ("string", "normalizedString", "token", "NMTOKEN", "NMTOKENS", "NCName")
BOUNDS = ("minInclusive", "minExclusive", "maxInclusive", "maxExclusive")

#: Lexical forms.
LEXICAL = {
    "language": "[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*",
    "boolean": "true|false|1|0",
    "date": "-?[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "dateTime": "-?[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?",
    "duration": "-?P(?=[0-9T])([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T(?=[0-9])([0-9]+H)?([0-9]+M)?([0-9]+(\\.[0-9]+)?S)?)?",
    "anyURI": "([A-Za-z][A-Za-z0-9+.\\-]*:)?[A-Za-z0-9\\-._~%!$&'()*+,;=:@/?\\[\\]]*(#[A-Za-z0-9\\-._~%!$&'()*+,;=:@/?]*)?",
    "NCName": NCNAME,
    "NMTOKEN": f"[{NAME_MORE}:]+",
    "NMTOKENS": f"[ \t\r\n]*[{NAME_MORE}:]+([ \t\r\n]+[{NAME_MORE}:]+)*[ \t\r\n]*",
}
SIGNED, UNSIGNED = "[+-]?[0-9]+", "\\+?[0-9]+"
DECIMAL = "[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)"
DOUBLE = "[+-]?(inf|infinity|nan|([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?)"

#: Strict forms: days that exist, times of a day, zones of at most 14 hours, and the spellings of XML Schema.
_LEAP = "-?(?!0000)(?:[1-9][0-9]*)?(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)-02-29"
_DAY = "-?(?:[1-9][0-9]{3,}|0(?!000)[0-9]{3})-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
_ZONE = "(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))?"
_TIME = "T(?:(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\\.[0-9]+)?|24:00:00(?:\\.0+)?)"
STRICT = {"date": f"(?:{_DAY}|{_LEAP}){_ZONE}", "dateTime": f"(?:{_DAY}|{_LEAP}){_TIME}{_ZONE}", "double": "[+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?|-?INF|NaN"}


class UserType(Protocol):
    """What a library's datatypes and values must offer; they are hashable and sent to the executors."""

    def check(self, s: str, *resolve) -> bool: ...

    def column(self, c: Column) -> Column: ...


class Library(NamedTuple):
    datatype: Callable[[str, list[tuple[str, str]]], UserType]  # name, facets; raises SchemaError
    value: Callable[[str, str], UserType]  # name, the pattern's text


_LIBRARIES: dict[str, Library] = {}


def register_library(uri: str, datatype: Callable[[str, list[tuple[str, str]]], UserType], value: Callable[[str, str], UserType]) -> None:
    """Makes a datatype library known by its URI to schemas that are compiled from now on."""
    if uri in (BUILTIN, XSD):
        raise ValueError("the built-in libraries can't be replaced")
    _LIBRARIES[uri] = Library(datatype, value)


#: What XML Schema patterns write shorter: characters that begin a name, characters of names, digits, blanks and what words are made of.
_SHORT = {"i": "\\p{L}_:", "c": f"{NAME_MORE}:", "d": "\\p{Nd}", "s": " \\t\\n\\r"}


def xsd_pattern(pattern: str, java: bool) -> str:
    """An XML Schema pattern for Java's dialect or for the regex module's: ^ and $ stand for themselves, classes may be subtracted, \\i and \\c are names' characters."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            i += 2
            if e.lower() in _SHORT:
                inner = _SHORT[e.lower()]
                out.append((f"[^{inner}]" if java or not depth else f"[^{inner}]") if e.isupper() else inner if depth else f"[{inner}]")
            elif e in "wW":
                out.append(f"[{'^' if e == 'w' else ''}\\p{{P}}\\p{{Z}}\\p{{C}}]")
            elif e in "pP" and pattern[i : i + 3] == "{Is":
                out.append(f"\\{e}{{In")
                i += 3
            else:
                out.append("\\" + e)
            continue
        if c == "[":
            depth += 1
            out.append("[")
        elif c == "]":
            depth -= 1
            out.append("]")
        elif c == "-" and depth and pattern[i + 1 : i + 2] == "[":
            end = pattern.index("]", i)
            inner = xsd_pattern(pattern[i + 1 : end + 1], java)
            out.append(f"&&[^{inner[1:]}" if java and inner[1] != "^" else f"&&[{inner[2:]}" if java else f"--{inner}")
            i = end + 1
            continue
        elif c in "^$" and not (c == "^" and depth and out[-1] == "["):
            out.append("\\" + c)
        elif c == "." and not depth:
            out.append("[^\\n\\r]")
        elif java and depth and c == "&":
            out.append("\\&")
        elif depth and c in "|~&" and pattern[i + 1 : i + 2] == c:
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return "".join(out)


def compiled_pattern(pattern: str) -> regex.Pattern:
    return regex.compile(xsd_pattern(pattern, False), regex.V1)


def full(pattern: str) -> str:
    return f"\\A(?:{pattern})\\z"


def py(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern.replace("\\p{Nd}", "\\d"), flags)


@dataclass(frozen=True)
class Datatype:
    """A compiled datatype: library URI, type name and facets in the order they were given."""

    library: str
    name: str
    facets: tuple[tuple[str, str], ...] = ()
    compat: bool = False

    def facet(self, name: str) -> str | None:
        return next((v for k, v in reversed(self.facets) if k == name), None)

    def patterns(self) -> list[str]:
        """Those that hold: all, in compat mode the last."""
        found = [v for k, v in self.facets if k == "pattern"]
        return found[-1:] if self.compat else found

    def normal(self, value: str) -> str:
        """The value as it is checked: blanks are collapsed in all types but string (compat: only where lists and tokens need it)."""
        return normalize_whitespace(value) if self.collapses() else value

    def collapses(self) -> bool:
        return bool(self.library) and (self.name in ("normalizedString", "token", "NMTOKENS") if self.compat else self.name != "string")

    def form(self) -> str:
        """The regular expression of a LEXICAL type or of double."""
        key = "NCName" if self.name in ("ID", "IDREF") else self.name
        return LEXICAL[key] if key not in STRICT else STRICT[key] if not self.compat else DOUBLE if key == "double" else LEXICAL[key]

    def check(self, value: str) -> bool:
        return checker(self)(value)

    def limits(self) -> dict[str, object]:
        """Facets by name as typed values: bounds as numbers, lengths and digits as whole numbers, patterns as a list."""
        out: dict[str, object] = {k: number(self.name, v) if k in BOUNDS else int(v) for k, v in self.facets if k != "pattern"}
        return out | ({"pattern": self.patterns()} if self.patterns() else {})

    def bounds(self) -> tuple[object | None, object | None]:
        """The least and the greatest value that the type and its facets leave, None where there is none: whole numbers inclusive, others as given."""
        low, high = WHOLE.get(self.name, (None, None)) if self.library == XSD else (None, None)
        if self.name == "positiveInteger" and not self.compat:
            low = 1
        for key, v in self.facets:
            if key in BOUNDS:
                b = number(self.name, v)
                if self.name in WHOLE and key.endswith("Exclusive"):
                    b += 1 if key.startswith("min") else -1
                if key.startswith("min"):
                    low = b if low is None else max(low, b)
                else:
                    high = b if high is None else min(high, b)
        return low, high

    def bounded(self) -> bool:
        """True where a facet (not only the type) gives a bound."""
        return any(k in BOUNDS for k, _ in self.facets)

    def lengths(self) -> tuple[int | None, int | None]:
        """The least and the greatest length."""
        low, high = self.facet("minLength") or self.facet("length"), self.facet("maxLength") or self.facet("length")
        return None if low is None else int(low), None if high is None else int(high)

    def derived(self) -> list[tuple[str, str]]:
        """bounds and lengths by name."""
        found = zip(("min", "max", "min_length", "max_length"), (*self.bounds(), *self.lengths()))
        return [(k, str(v)) for k, v in found if v is not None]

    def column(self, c: Column, normal: Column | None = None) -> Column:
        """True where the value is valid; false for null.  normal: c with its blanks collapsed, where it is at hand."""
        return F.coalesce(c.isNotNull() & _column(self, c, normal), F.lit(False))


def compile_datatype(library: str, name: str, facets: list[tuple[str, str]], compat: bool = False) -> Datatype:
    """Checks that type and facets exist and agree."""
    if library == BUILTIN:
        if name not in ("string", "token"):
            raise SchemaError("UnsupportedDatatype", f"{name} is not a built-in datatype")
        if facets:
            raise SchemaError("ParamNotAllowed", f"{name} takes no parameters")
        return Datatype(library, name)
    if library in _LIBRARIES:
        return _LIBRARIES[library].datatype(name, facets)
    if library != XSD:
        raise SchemaError("UnsupportedDatatypeLibrary", f"unknown datatype library {library}")
    if name not in WHOLE and name not in STRINGS and name not in ("decimal", "double"):
        raise SchemaError("UnsupportedDatatype", f"xsd:{name} is not supported")
    numeric = name in WHOLE or name in ("decimal", "double")
    seen: dict[str, str] = {}
    for key, value in facets:
        ok = key == "pattern" or (key in BOUNDS and numeric) or (key in ("length", "minLength", "maxLength") and name in WITH_LENGTH) or (key in ("fractionDigits", "totalDigits") and name == "decimal")
        if not ok:
            raise SchemaError("InvalidFacet", f"xsd:{name} has no facet {key}")
        if key in seen and key != "pattern":
            raise SchemaError("ConflictingFacet", f"{key} is given twice")
        seen[key] = value
        try:
            if key == "pattern":
                py(value) if compat else compiled_pattern(value)
            elif key in BOUNDS:
                number(name, value)
            elif not re.fullmatch("[0-9]+", value):
                raise ValueError(value)
        except (re.error, regex.error, ValueError, ArithmeticError):
            kind = "InvalidPattern" if key == "pattern" else "InvalidFloat" if name == "double" else "InvalidInt"
            raise SchemaError(kind, f"{value!r} is no value of {key}") from None
    if ("minInclusive" in seen and "minExclusive" in seen) or ("maxInclusive" in seen and "maxExclusive" in seen) or ("length" in seen and ("minLength" in seen or "maxLength" in seen)):
        raise SchemaError("ConflictingFacet", "facets exclude each other")
    if "minLength" in seen and "maxLength" in seen and int(seen["minLength"]) > int(seen["maxLength"]):
        raise SchemaError("ConflictingFacet", "minLength is over maxLength")
    low = next((number(name, seen[k]) for k in BOUNDS[:2] if k in seen), None)
    high = next((number(name, seen[k]) for k in BOUNDS[2:] if k in seen), None)
    if low is not None and high is not None and low > high:
        raise SchemaError("ConflictingFacet", "the lower bound is over the upper")
    return Datatype(library, name, tuple(facets), compat)


def number(name: str, text: str):
    if name == "double":
        if not py(DOUBLE, re.I).fullmatch(text) or (x := float(text)) != x or x in (float("inf"), float("-inf")):
            raise ValueError(text)
        return x
    if name == "decimal":
        if not re.fullmatch(DECIMAL, text):
            raise ValueError(text)
        return Decimal(text)
    if not re.fullmatch(SIGNED, text):
        raise ValueError(text)
    return int(text)


_CHECKS: dict[Datatype, Callable[[str], bool]] = {}


def checker(d: Datatype) -> Callable[[str], bool]:
    """The type's check, built once."""
    if d not in _CHECKS:
        _CHECKS[d] = _checker(d)
    return _CHECKS[d]


def _checker(d: Datatype) -> Callable[[str], bool]:
    if d.library == BUILTIN:
        return lambda s: True
    tests: list[Callable[[str], bool]] = []
    for pattern in d.patterns():
        tests.append(lambda s, found=py(pattern): bool(found.search(s))) if d.compat else tests.append(lambda s, found=compiled_pattern(pattern): bool(found.fullmatch(s)))
    if d.name in WHOLE or d.name in ("decimal", "double"):
        lexical = py(d.form(), (re.I if d.compat else 0) | re.A) if d.name == "double" else py(DECIMAL if d.name == "decimal" else SIGNED if WHOLE[d.name][0] != 0 else UNSIGNED, re.A)
        low, high = WHOLE.get(d.name, (None, None))
        if d.name == "positiveInteger" and not d.compat:
            low = 1
        read = {"double": float, "decimal": Decimal}.get(d.name, int)
        bounds = [] if d.compat and d.name == "double" else [(k, number(d.name, v)) for k, v in d.facets if k in BOUNDS]

        def whole(s: str) -> bool:
            if not lexical.fullmatch(s):
                return False
            x = read(s)
            if (low is not None and x < low) or (high is not None and x > high):
                return False
            return all({"minInclusive": x >= b, "minExclusive": x > b, "maxInclusive": x <= b, "maxExclusive": x < b}[k] for k, b in bounds)

        tests.append(whole)
        if d.name == "decimal" and not d.compat:
            for key, at in (("fractionDigits", 1), ("totalDigits", 0)):
                if (most := d.facet(key)) is not None:
                    tests.append(lambda s, at=at, most=int(most): len(_digits(s)[at]) + (0 if at else len(_digits(s)[1])) <= most)
    elif d.name in LEXICAL or d.name in ("ID", "IDREF"):
        key = "NCName" if d.name in ("ID", "IDREF") else d.name
        if not (d.compat and d.name in ("ID", "IDREF")):
            form = py(d.form(), re.A if key in ("date", "dateTime", "duration") else 0)
            tests.append(lambda s: bool(form.fullmatch(s)))
        if d.name == "date" and d.compat:
            tests.append(_is_date)
    least, most, exact = (d.facet(k) for k in ("minLength", "maxLength", "length"))
    if least or most or exact:
        size = (lambda s: len(s.split())) if d.name == "NMTOKENS" else len
        tests.append(lambda s: (least is None or size(s) >= int(least)) and (most is None or size(s) <= int(most)) and (exact is None or size(s) == int(exact)))
    return lambda s: all(t(v) for v in [d.normal(s)] for t in tests)


def _digits(s: str) -> tuple[str, str]:
    whole, _, part = s.lstrip("+-").partition(".")
    return whole.lstrip("0"), part.rstrip("0")


def _is_date(s: str) -> bool:
    year, month, day = map(int, s.lstrip("-").split("-"))
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    return 1 <= month <= 12 and 1 <= day <= (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]


def _bound(x: Column, key: str, b: Column) -> Column:
    return {"minInclusive": x >= b, "minExclusive": x > b, "maxInclusive": x <= b, "maxExclusive": x < b}[key]


def _parts(c: Column) -> tuple[Column, Column, Column]:
    """(is it below zero, whole digits, digits of the fraction) of a number as text, without idle zeros."""
    whole = F.regexp_extract(c, "\\A[+-]?0*([0-9]*)", 1)
    part = F.regexp_replace(F.regexp_extract(c, "\\.([0-9]*)", 1), "0+\\z", "")
    return c.startswith("-") & ((whole != "") | (part != "")), whole, part


def _order(c: Column, value: int | Decimal, key: str) -> Column:
    """Compares a number of any length, as text: by sign, length and digits of the whole part, then the fraction's digits.  key: a bound, or equal."""
    minus, whole, part = _parts(c)
    sign, digits, exponent = Decimal(value).as_tuple()
    text = "".join(map(str, digits)) + "0" * max(exponent, 0)
    cut = len(text) + min(exponent, 0)
    own, rest = (text[:cut] if cut > 0 else "").lstrip("0"), (("0" * -cut if cut < 0 else "") + text[max(cut, 0) :] if exponent < 0 else "").rstrip("0")
    below = bool(sign) and bool(own or rest)
    size = F.length(whole)
    alike = whole == own
    bigger = (size > len(own)) | ((size == len(own)) & (whole > own)) | (alike & (part > rest))
    same = alike & (part == rest)
    if below:
        above, equal = ~minus | (~bigger & ~same), minus & same
    else:
        above, equal = ~minus & bigger, ~minus & same
    return {"minInclusive": above | equal, "minExclusive": above, "maxInclusive": ~above, "maxExclusive": ~above & ~equal, "equal": equal}[key]


def _column(d: Datatype, c: Column, normal: Column | None = None) -> Column:
    if d.library == BUILTIN:
        return F.lit(True)
    v = (normalize_ws(c) if normal is None else normal) if d.collapses() else c
    out = F.lit(True)
    for pattern in d.patterns():
        out = out & v.rlike(pattern if d.compat else full(xsd_pattern(pattern, True)))
    if d.name in WHOLE:
        low, high = WHOLE[d.name]
        out = out & v.rlike(full(SIGNED if low != 0 else UNSIGNED))
        if d.name == "positiveInteger" and not d.compat:
            low = 1
        cast = {"short": "smallint", "int": "int", "long": "bigint", "unsignedShort": "bigint", "unsignedInt": "bigint"}.get(d.name)
        x = v.try_cast(cast) if cast else None
        limits = [(k, number(d.name, b)) for k, b in d.facets if k in BOUNDS]
        if cast:
            out = out & x.isNotNull() & (x.between(low, high) if cast == "bigint" and d.name != "long" else F.lit(True))
            out = out if not limits else out & _all(_bound(x.cast("decimal(38,0)"), k, F.lit(Decimal(b))) for k, b in limits)
        else:
            limits += [("minInclusive", low)] * (low is not None) + [("maxInclusive", high)] * (high is not None)
            exact = _all(_order(v, b, k) for k, b in limits)
            if limits and all(abs(b) < 2**63 for _, b in limits):  # most numbers are short
                x = v.try_cast("bigint")
                exact = F.when(v.rlike(full("[+-]?[0-9]{1,18}")), _all(_bound(x, k, F.lit(int(b)).cast("bigint")) for k, b in limits)).otherwise(exact)
            out = out & exact
    elif d.name == "decimal":
        out = out & v.rlike(full(DECIMAL))
        for k, b in d.facets:
            if k in BOUNDS:
                out = out & _order(v, number("decimal", b), k)
        if not d.compat:
            _, whole, part = _parts(v)
            if (n := d.facet("fractionDigits")) is not None:
                out = out & (F.length(part) <= int(n))
            if (n := d.facet("totalDigits")) is not None:
                out = out & (F.length(whole) + F.length(part) <= int(n))
    elif d.name == "double":
        out = out & v.rlike(("(?i)" if d.compat else "") + full(d.form()))
        if not d.compat:
            for k, b in d.facets:
                if k in BOUNDS:  # nan is beyond every bound
                    x = v.try_cast("double")
                    out = out & ~F.isnan(x) & _bound(x, k, F.lit(number("double", b)))
    elif d.name in LEXICAL or d.name in ("ID", "IDREF"):
        if not (d.compat and d.name in ("ID", "IDREF")):
            out = out & v.rlike(full(d.form()))
        if d.name == "date" and d.compat:
            out = out & F.regexp_replace(v, "\\A-", "").try_cast("date").isNotNull()
    size = F.size(F.split(v, " ")) if d.name == "NMTOKENS" else F.length(v)
    for key, test in (("minLength", size.__ge__), ("maxLength", size.__le__), ("length", size.__eq__)):
        if (n := d.facet(key)) is not None:
            out = out & test(int(n))
    return out


def _all(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


@dataclass(frozen=True)
class Value:
    """A value pattern: the type decides how the instance's text is compared. namespace: of a QName's prefix."""

    library: str
    name: str
    value: str
    namespace: str = ""

    def key(self, s: str) -> object:
        d = self.name
        if (self.library, d) in ((BUILTIN, "string"), (XSD, "string")):
            return s
        s = normalize_whitespace(s)
        if d in WHOLE and re.fullmatch(SIGNED, s):
            return int(s)
        if d == "decimal" and re.fullmatch(DECIMAL, s):
            return Decimal(s)
        if d == "double" and re.fullmatch(DOUBLE, s, re.I):
            return float(s)
        if d == "boolean" and s in ("true", "1", "false", "0"):
            return s in ("true", "1")
        return s

    def check(self, s: str, resolve: Callable[[str], str | None] | None = None) -> bool:
        if self.name == "QName" and self.library == XSD:
            prefix, _, local = normalize_whitespace(s).rpartition(":")
            own = self.value.rpartition(":")[2]
            return local == own and ((resolve(prefix) if resolve else None) or "") == self.namespace
        return self.key(s) == self.key(self.value)

    def column(self, c: Column, prefixes: dict[str, str] | None = None, normal: Column | None = None) -> Column:
        """True where check() is. prefixes: what stands for a QName's prefixes (the empty one too) wherever the column comes from.  normal: c with its blanks collapsed, where it is at hand."""
        return F.coalesce(self._same(c, prefixes or {}, normal), F.lit(False))

    def _same(self, c: Column, prefixes: dict[str, str], normal: Column | None) -> Column:
        if (self.library, self.name) in ((BUILTIN, "string"), (XSD, "string")):
            return c == self.value
        v, own = normalize_ws(c) if normal is None else normal, normalize_whitespace(self.value)
        if self.library != XSD:
            return v == own
        if self.name == "QName":
            prefix = F.regexp_extract(v, "\\A(.*):", 1)
            space = F.lit("")
            for p, uri in prefixes.items():
                space = F.when(prefix == p, uri).otherwise(space)
            return (F.substring_index(v, ":", -1) == own.rpartition(":")[2]) & (space == self.namespace)
        mine = self.key(self.value)
        if isinstance(mine, bool):
            return v.isin("true", "1") if mine else v.isin("false", "0")
        if isinstance(mine, int):
            return v.rlike(full(SIGNED)) & _order(v, mine, "equal")
        if isinstance(mine, Decimal):
            return v.rlike(full(DECIMAL)) & _order(v, mine, "equal")
        if isinstance(mine, float):  # nan is no value's equal
            return F.lit(False) if mine != mine else v.rlike("(?i)" + full(DOUBLE)) & (v.try_cast("double") == mine) & ~F.isnan(v.try_cast("double"))
        return v == own


def compile_value(library: str, name: str, value: str, namespace: str = "") -> Value:
    if library == BUILTIN and name in ("string", "token"):
        return Value(library, name, value)
    if library in _LIBRARIES:
        return _LIBRARIES[library].value(name, value)
    if library != XSD:
        raise SchemaError("UnsupportedDatatypeLibrary", f"unknown datatype library {library}")
    if name != "QName":
        d = compile_datatype(library, name, [])
        if not d.check(value if name == "string" else normalize_whitespace(value)):
            raise SchemaError("InvalidValue", f"{value!r} is no xsd:{name}")
    return Value(library, name, value, namespace)
