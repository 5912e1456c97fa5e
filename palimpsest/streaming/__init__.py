"""Streaming of the claim library."""
