"""Inputs: SQL text and its dialects, column types, and metadata documents."""
