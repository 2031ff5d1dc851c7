"""Naming and time functions."""
