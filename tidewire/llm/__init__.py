"""Operators for large training corpora: deduplication, filtering, mixing, packing, search."""
