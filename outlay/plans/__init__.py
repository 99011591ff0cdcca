"""User-level analyses composed from the operators."""
