"""Operators for preparing training text; nothing else in the library depends on this subpackage.

Column names that start with `__llm_` are reserved for the operators; inputs must not have any.
"""
