"""Operators of a training-data pipeline (deduplication, scans, mixing, packing, archives).

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own interface; ``queries`` binds them to the driver's tables.
"""
