"""Functions of granary."""
