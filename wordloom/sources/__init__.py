"""sources of the analytics engine."""
