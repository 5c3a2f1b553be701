"""Scalar functions and types by their dialect names."""
