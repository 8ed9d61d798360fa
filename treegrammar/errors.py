"""Errors of schemas; a schema that compiles never raises while documents are validated."""

from typing import NamedTuple


class Place(NamedTuple):
    """Where else to look: note says why, start and end are character offsets in file."""

    note: str
    file: str
    start: int
    end: int


class SchemaError(Exception):
    """kind names the error; file and span (character offsets) say where it was found.

    places: what it contradicts (the first definition, the rules of a cycle), then the includes that led to the file, innermost first.
    """

    def __init__(self, kind: str, message: str, file: str = "", span: tuple[int, int] = (0, 0), places: tuple[Place, ...] = ()):
        super().__init__(f"{kind}: {message}" + (f" ({file}:{span[0]}-{span[1]})" if file else ""))
        self.kind, self.message, self.file, self.span, self.places = kind, message, file, span, tuple(places)

    def __reduce__(self):
        return SchemaError, (self.kind, self.message, self.file, self.span, self.places)

    def all_places(self) -> list[Place]:
        return [Place("here", self.file, *self.span), *self.places]

    def described(self, texts: dict[str, str]) -> str:
        """The message and a line for each place: its line, column and source line. texts: of the files that are at hand."""
        out = [f"{self.kind}: {self.message}"]
        for note, file, start, _ in self.all_places():
            text = texts.get(file)
            if text is None:
                out.append(f"  {note}: {file}")
                continue
            begin = text.rfind("\n", 0, start) + 1
            out.append(f"  {note}: {file}:{text.count(chr(10), 0, start) + 1}:{start - begin + 1}: {text[begin:].split(chr(10), 1)[0]}")
        return "\n".join(out)
