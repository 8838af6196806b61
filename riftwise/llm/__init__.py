"""Training-data operators: deduplication, filtering, mixing, tokenising and web archives.

Nothing else in the library imports this subpackage.
"""
