"""Column functions on log text."""
