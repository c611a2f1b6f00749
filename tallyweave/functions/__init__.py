"""Hashes, running sums and sizing rules."""
