"""python -m treegrammar validate SCHEMA XML...: exit 1 for a bad schema, 2 if a document is not valid."""

from __future__ import annotations

import sys

from treegrammar.errors import SchemaError
from treegrammar.operators.pool import Pool
from treegrammar.operators.validate import validate_text
from treegrammar.plans.model import compile_schema
from treegrammar.sources.schemas import Disk


class Kept(Disk):
    """Keeps the files it has read, for messages."""

    def __init__(self):
        self.texts: dict[str, str] = {}

    def load(self, path: str) -> str:
        self.texts[path] = super().load(path)
        return self.texts[path]


def main(args: list[str]) -> int:
    if len(args) < 3 or args[0] != "validate":
        print(__doc__, file=sys.stderr)
        return 1
    loader = Kept()
    try:
        pool = Pool(compile_schema(args[1], loader))
    except SchemaError as e:
        print(e.described(loader.texts), file=sys.stderr)
        return 1
    bad = 0
    for path in args[2:]:
        with open(path, encoding="utf-8") as f:
            valid, kind, message, _, line, col, expected, *_ = validate_text(pool, f.read())
        if not valid:
            bad = 2
            print(f"{path}:{line}:{col}: {message}" + (f"; expected {expected}" if expected else ""), file=sys.stderr)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
