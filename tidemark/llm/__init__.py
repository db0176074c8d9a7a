"""Operators that a large training-data pipeline needs. Nothing outside this subpackage imports it."""
