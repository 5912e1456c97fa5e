"""Functions of the claim library."""
