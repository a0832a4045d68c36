"""Comparisons of revision pairs as they arrive."""
