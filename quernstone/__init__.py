"""Ranked retrieval and analytics over project knowledge, on Spark."""
