"""Incremental runs of the append operators."""
