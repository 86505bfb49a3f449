"""Operators for preparing text corpora: filters, deduplication, tokens, packing, search."""
