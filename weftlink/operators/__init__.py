"""Relational operators of the linkage workflow."""
