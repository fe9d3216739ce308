"""Operators on DataFrames of (vid, vec, metadata...)."""
