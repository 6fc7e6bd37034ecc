"""Operators for preparing large training-data collections.

Each operator is one module with its own docstring; ``queries`` registers the
fixed-contract queries over the driver's tables.  Nothing outside this
subpackage imports it.
"""
