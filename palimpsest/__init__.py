"""Extent and write-log analytics on Spark."""
