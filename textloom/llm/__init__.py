"""Operators for large collections of training text. Nothing outside this subpackage imports it."""
