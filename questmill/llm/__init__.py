"""Operators for preparing training text: near-duplicates, tokens, pages, shards, packing, vectors, quality, personal data, language."""
