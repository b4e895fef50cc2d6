"""Operators for building training data: sharding, archives, search, deduplication, packing, mixing."""
