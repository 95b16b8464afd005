"""Spark jobs that turn trees of Java source into a queryable code graph."""
