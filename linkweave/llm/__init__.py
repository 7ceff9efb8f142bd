"""Training-data operators: deduplication, extraction, filtering, mixing, formatting.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
