"""plans of the tidegate engine."""
