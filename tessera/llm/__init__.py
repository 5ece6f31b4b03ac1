"""Operators for preparing training text: one module for each, plus their queries.

Nothing outside this subpackage imports it.
"""
