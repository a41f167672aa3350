"""Readers, sinks and catalogues of matches."""
