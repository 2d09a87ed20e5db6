"""Operators for preparing training data: deduplication, cleaning, mixing, formatting and sharding of documents."""
