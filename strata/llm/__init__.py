"""Operators of a large-scale training-data pipeline.

Each module holds one operator with its own general interface; ``queries``
binds them to the benchmark tables.  Nothing outside this package imports it.
"""
