"""Operators for building training corpora: each module has one operator and its query."""
