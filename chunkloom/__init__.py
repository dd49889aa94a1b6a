"""Deduplication analytics on Spark."""
