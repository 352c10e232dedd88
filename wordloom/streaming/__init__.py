"""streaming of the analytics engine."""
