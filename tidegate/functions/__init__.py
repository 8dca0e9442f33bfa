"""functions of the tidegate engine."""
