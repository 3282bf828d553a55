"""Hybrid vector search on Spark: exact and approximate nearest neighbours under attribute predicates and labels."""
