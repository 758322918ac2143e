"""Similarity-based transaction scoring on Spark."""
