"""streaming of the tidegate engine."""
