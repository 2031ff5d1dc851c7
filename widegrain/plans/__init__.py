"""Manifest model, validation, planning and row estimates; plain Python, no Spark."""
