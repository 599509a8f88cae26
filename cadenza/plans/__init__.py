"""Whole use cases composed from the operators, and the query registry."""
