"""Scenario-dynamics analytics on PySpark: consistent scenarios, basins, structure and levers of cross-impact models."""
