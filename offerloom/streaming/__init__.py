"""Incremental runs: the batch functions on arriving data."""
