"""Operators for building training corpora, their queries and the SQL that checks them."""
