"""Relational operators on event tables."""
