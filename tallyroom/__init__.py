"""Spark jobs for examination data."""
