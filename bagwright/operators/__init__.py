"""Relational operators over DataFrames: bag semantics, three-valued logic, optional provenance."""
