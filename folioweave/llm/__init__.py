"""Operators that prepare training data: duplicates, records across sources, truncation, tokens, packing, languages.

Nothing outside this package imports it.
"""
