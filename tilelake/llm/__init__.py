"""Operators for preparing training text at scale: near-duplicate joins, filters, tokenising, packing, sharding."""
