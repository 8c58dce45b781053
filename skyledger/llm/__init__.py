"""Operators for preparing training text: counting, redaction, filtering, dedup, packing, search."""
