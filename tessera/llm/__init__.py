"""Operators that prepare training data: cleaning, deduplication, scoring, sharding and packing."""
