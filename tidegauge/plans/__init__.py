"""Whole analyses: reports, findings, profiles and their renderings."""
