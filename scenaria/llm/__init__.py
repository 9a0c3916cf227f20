"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it, so that it can be removed as a whole.
"""
