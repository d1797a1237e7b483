"""Training-data operators: deduplication, quality, tokens, archives and packing.

Nothing outside this subpackage imports it.
"""
