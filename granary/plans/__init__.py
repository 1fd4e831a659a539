"""Plans of granary."""
