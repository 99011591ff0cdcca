"""Incremental forms of the landing and of the live run view."""
