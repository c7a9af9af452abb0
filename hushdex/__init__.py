"""Blind-index search and corpus preparation on Spark."""
