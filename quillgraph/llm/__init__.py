"""Operators for preparing training text: packing, mixing, quality, deduplication, archives, scoring."""
