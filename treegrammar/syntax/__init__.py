"""Schema syntax: tree, compact reader, XML reader."""
