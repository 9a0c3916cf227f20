"""Succession rules and the batch dynamics that operators run on executors."""
