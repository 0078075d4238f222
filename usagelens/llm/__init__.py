"""Operators for preparing training text: cleaning, duplicates, packing, tokens and models."""
