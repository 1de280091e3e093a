"""Training-data operators: deduplication, extraction, tokenising, filtering and sharding.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
