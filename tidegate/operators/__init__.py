"""operators of the tidegate engine."""
