"""Operators for preparing text corpora; self-contained, nothing else in the library imports it."""
