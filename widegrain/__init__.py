"""Pivot-safe wide tables on Spark, declared in a manifest."""
