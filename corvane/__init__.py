"""Corvane: text screening and corpus preparation on Spark."""
