"""Sources of the claim library."""
