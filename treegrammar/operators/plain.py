"""The automaton over whole tags, for documents of plain markup.

A document is split at "<" into tokens, each a tag with the text behind it.  What a token does to a run (validate.Run or validate.Recovering)
depends only on the run's state and on the text that waits; it is found once, with the run's own methods, and then looked up, so that documents
with the same tags in the same states cost a dictionary access for each tag.  Errors are kept with their place within the token.

Plain are documents of ASCII names without prefixes and declarations, without references, comments, sections and instructions, that are well-formed.
For all others, and for an end that comes too early, found() says None, and expat reads the document from its start.
"""

from __future__ import annotations

import re

from treegrammar.functions.text import is_whitespace
from treegrammar.operators.pool import LONG, MEMO

_NAME, _BLANK = r"[A-Za-z_][A-Za-z0-9_.\-]*", r"[ \t\n]"
_REST = "\u007f-퟿-�\U00010000-\U0010ffff"
_DOUBLE, _SINGLE, _TEXT = f"[ !#-%'-;=-~{_REST}]*", f"[ -%(-;=-~{_REST}]*", f"[\t\n -%'-;=-~{_REST}]*"
_PAIR = re.compile(f"""({_NAME}){_BLANK}*={_BLANK}*(?:"({_DOUBLE})"|'({_SINGLE})')""")
_START = re.compile(f"""({_NAME})((?:{_BLANK}+{_NAME}{_BLANK}*={_BLANK}*(?:"{_DOUBLE}"|'{_SINGLE}'))*){_BLANK}*(/?)>({_TEXT})""")
_END = re.compile(f"/({_NAME}){_BLANK}*>({_TEXT})")
#: What a remembered step takes besides its token's characters.
_STEP = 500


class _Place:
    """Where a run is within a token, as expat would say."""

    CurrentLineNumber = 1

    def __init__(self) -> None:
        self.CurrentByteIndex = self.CurrentColumnNumber = 0

    def move(self, to: int) -> None:
        self.CurrentByteIndex = self.CurrentColumnNumber = to


class Plain:
    def __init__(self, run, failure: type[Exception]):
        self.run, self.failure, self.pool = run, failure, run.pool
        run.parser = _Place()
        self.outside = (object(), None)  # the open element around a token
        self.first = not hasattr(run, "found")  # does the first error end the run
        self.forget()

    def forget(self) -> None:
        self.held = 0
        self.steps: dict[tuple[int, str], tuple] = {}
        self.states: list[tuple] = [(self.pool.start, "", False, 0, False)]
        self.places: dict[tuple, int] = {}  # the start is only where documents start

    def step(self, at: int, token: str) -> tuple | None:
        """(state after the token, element it opens, name it closes, its errors)."""
        if len(token) > LONG or "]]>" in token:
            return None
        run = self.run
        run.state, waits, run.leaf, run.passed, run.excused = self.states[at]
        run.text[:] = [waits]
        run.path[:] = [self.outside]
        run.scopes[1:] = [run.scopes[0]]
        run.found = []
        run.parser.move(0)
        opened = closed = None
        try:
            if m := _END.fullmatch(token):
                closed, text = m.groups()
                run.close(closed)
            elif m := _START.fullmatch(token):
                raw, inner, empty, text = m.groups()
                flat = [x for name, double, single in _PAIR.findall(inner) for x in (name, double or single)]
                keys = flat[::2]
                if "xmlns" in keys or len(set(keys)) < len(keys):
                    return None
                run.open(raw, flat)
                if empty:
                    run.parser.move(1 + len(token) - len(text))  # with the "<"
                    run.close(raw)
                else:
                    opened = (raw, keys)
            else:
                return None
        except self.failure as e:
            run.found = [(0, e.kind, e.message, e.start, e.line, e.col, e.expected, *run.path[-1])]
        key = (run.state, "" if run.passed else text, run.leaf, run.passed, run.excused)
        to = self.places.get(key)
        if to is None:
            to = self.places[key] = len(self.states)
            self.states.append(key)
        out = self.steps[at, token] = (to, opened, closed, run.found)
        self.held += len(token) + _STEP
        return out

    def found(self, xml: str) -> list[tuple] | None:
        """The document's errors (only the first where a run ends there), or None."""
        tokens = xml.split("<")
        if tokens[0] or len(tokens) < 2:
            return None
        if self.held > MEMO:
            self.forget()
        steps, at, stack, roots, errors = self.steps, 0, [], 0, []
        for i, token in enumerate(tokens):
            if not i:
                continue
            step = steps.get((at, token)) or self.step(at, token)
            if step is None:
                return None
            at, opened, closed, wrong = step
            if closed is not None and (not stack or stack[-1][0] != closed):
                return None
            if wrong:
                if roots or not xml.isascii() or "\n" in xml:
                    return None
                shift = sum(map(len, tokens[:i])) + i - 1
                around = stack[-1] if stack else (None, None)
                errors += [(len(errors) + n, kind, message, start + shift, line, col + shift, expected, *(around if raw is self.outside[0] else (raw, keys))) for n, kind, message, start, line, col, expected, raw, keys in wrong]
                if self.first:
                    return errors
            if opened is not None:
                stack.append(opened)
                continue
            if closed is not None:
                stack.pop()
            roots += not stack
        state, waits, *_ = self.states[at]
        if stack or roots != 1 or not is_whitespace(waits) or not errors and not self.pool.nullable[state]:
            return None
        return errors
