"""Operators for building training text.  Nothing outside this subpackage imports it."""
