"""Training-data operators: sharding, deduplication, scanning, packing, search and scoring.

The rest of the library does not import this subpackage.
"""
