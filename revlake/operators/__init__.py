"""Relational operators of the comparison."""
