"""Relational and statistical operators of the two analyses."""
