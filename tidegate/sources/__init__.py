"""sources of the tidegate engine."""
