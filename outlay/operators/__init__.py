"""Relational building blocks: each takes and returns DataFrames and never starts a job."""
