"""Incremental processing of newly landed matches."""
