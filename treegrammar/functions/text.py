"""Names, white space and entities, as Python checks and as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that may begin a name, and those that may follow besides (fixed values of the XML name grammar, without the colon).
NAME_START = "A-Z_a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c-\u200d\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff"
NAME_MORE = NAME_START + "\\-.0-9\u00b7\u0300-\u036f\u203f-\u2040"
NCNAME = f"[{NAME_START}][{NAME_MORE}]*"
XML_SPACE = " \t\r\n"
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def normalize_whitespace(s: str) -> str:
    """Runs of blank, tab, newline, form feed and return become one blank; none is left at the ends."""
    return re.sub("[ \t\n\f\r]+", " ", s).strip(" ")


def normalize_ws(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[ \t\n\f\r]+", " "), "^ | $", "")


def is_whitespace(s: str) -> bool:
    return not s.strip(XML_SPACE)


def is_whitespace_column(c: Column) -> Column:
    return c.rlike("\\A[ \t\r\n]*\\z")


def entity_names(c: Column) -> Column:
    """Names of the entity references in markup, in order."""
    return F.regexp_extract_all(c, F.lit("&([^;&<]+);"), F.lit(1))


def parse_entities(s: str) -> list[tuple[str, int, str]]:
    """(kind, offset, value) pieces of text: text, entity (a name) or char (a numeric reference); raises ValueError on an open or invalid one."""
    out, at = [], 0
    while at < len(s):
        amp = s.find("&", at)
        if amp < 0:
            amp = len(s)
        if amp > at:
            out.append(("text", at, s[at:amp]))
        if amp == len(s):
            break
        end = s.find(";", amp)
        if end < 0 or end == amp + 1:
            raise ValueError(f"entity at {amp} is not closed")
        name = s[amp + 1 : end]
        if name.startswith("#"):
            try:
                code = int(name[2:], 16) if name[1:2] == "x" else int(name[1:], 10)
                if not name[1:].isalnum() or 0xD800 <= code <= 0xDFFF:
                    raise ValueError
                out.append(("char", amp + 1, chr(code)))
            except (ValueError, OverflowError):
                raise ValueError(f"invalid numeric entity at {amp}") from None
        else:
            out.append(("entity", amp + 1, name))
        at = end + 1
    return out


def list_items(c: Column) -> Column:
    """Tokens of a list value."""
    return F.filter(F.split(c, "\\s+"), lambda t: t != "")
