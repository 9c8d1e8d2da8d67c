"""Typed readers and report writers."""
