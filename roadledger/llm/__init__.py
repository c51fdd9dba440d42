"""Operators for preparing training text: ten methods over documents, pages and benchmarks.

Nothing outside this subpackage imports it, so it can be deleted as a whole.
"""
