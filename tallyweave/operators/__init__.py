"""Operators over weighted key streams."""
