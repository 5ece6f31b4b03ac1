"""Seed-based discovery over works, tags and authors, on Spark DataFrames."""
