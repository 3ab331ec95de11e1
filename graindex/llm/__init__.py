"""Operators for large training-data pipelines; nothing outside this subpackage imports it."""
