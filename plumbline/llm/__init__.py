"""Operators of a training-data pipeline: mixing, filtering, search, packing, archives, counting, deduplication.

Each module holds one operator with its own interface; ``queries`` holds the
registered queries on top of them.
"""
