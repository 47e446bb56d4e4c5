"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this package, and it imports nothing from
the genomic side, so either can be removed without the other noticing.
"""
