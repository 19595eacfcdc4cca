"""Operators for preparing training text at scale: packing, joins, dedup, tokens, filters, search, archives."""
