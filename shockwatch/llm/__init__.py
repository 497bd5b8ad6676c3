"""Training-data operators: quality, search, packing, deduplication, extraction, mixing.

Nothing else in the package imports this subpackage.
"""
