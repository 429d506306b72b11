"""Training-data operators: quality, counting, deduplication, formatting, archives and mixing.

Nothing outside this package imports it.
"""
