"""Operators of a training-data pipeline over a ``documents`` table.

Each module holds one operator; ``queries`` registers them over the driver's tables.
"""
