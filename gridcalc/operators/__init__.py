"""Frames, aggregates and lookups: the operators that need more than the row itself."""
