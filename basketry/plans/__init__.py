"""The two analyses as named queries over the given tables."""
