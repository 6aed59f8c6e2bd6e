"""Operators for preparing training text: scores, duplicates, archives, mixing and packing."""
