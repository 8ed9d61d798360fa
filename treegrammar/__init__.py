"""treegrammar: validation and profiling of XML document collections on Spark."""

__version__ = "0.1.0"
