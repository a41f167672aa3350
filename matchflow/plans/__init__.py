"""Compositions of operators over many matches."""
