"""Queries over the given tables, each with the SQL that says what it computes."""
