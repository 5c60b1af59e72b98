"""Column functions over paths, flags and patterns."""
