"""Operators for training-data corpora: search, filtering, de-duplication, packing.

Nothing outside this subpackage imports it.
"""
