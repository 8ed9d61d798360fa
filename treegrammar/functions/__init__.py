"""Datatypes, text functions and name classes, as Python checks and as columns."""
