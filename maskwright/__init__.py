"""Sensitive-text analytics on Spark: find, resolve, replace and audit sensitive spans."""
