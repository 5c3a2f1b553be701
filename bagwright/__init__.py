"""bagwright: relational bag semantics, explained results and ordered state on PySpark."""

__version__ = "0.1.0"
