"""Spending analytics on Spark: card exports to gold facts, declarative analysis, retrieval, run and cost reports."""
