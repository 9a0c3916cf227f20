"""Merging shares of a long basin run while they arrive."""

from .shares import merged_stream

__all__ = ["merged_stream"]
