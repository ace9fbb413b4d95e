"""Operators for preparing training text: filters, deduplication, mixing, packing, extraction, archives, search."""
