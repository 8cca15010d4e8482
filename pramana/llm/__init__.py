"""Training-data operators: scoring, deduplication, tokenising, search and packing.

Nothing outside this subpackage imports it.
"""
