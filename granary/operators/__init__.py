"""Operators of granary."""
