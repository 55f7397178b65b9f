"""Operators of a large-scale training-data pipeline, each a DataFrame-to-DataFrame function.

Nothing else in the library imports this subpackage.
"""
