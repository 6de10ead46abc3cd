"""Training-data operators: tokenising, filtering, archiving, deduplicating, sharding and packing documents.

Nothing outside this package imports it.
"""
