"""Summaries over unbounded input."""
