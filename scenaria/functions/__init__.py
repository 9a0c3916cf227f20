"""Column expressions, the pinned generator and interval statistics."""
