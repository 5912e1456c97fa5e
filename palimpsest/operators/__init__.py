"""Operators of the claim library."""
