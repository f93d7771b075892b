"""Operators for preparing training data: filters, scoring, near-duplicates, tokenising and packing.

Nothing else in the library imports this subpackage.
"""
