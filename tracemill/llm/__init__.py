"""Operators for building training corpora; their registered queries are in `queries`."""
