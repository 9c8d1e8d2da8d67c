"""Registered queries over tables derived from the given ones."""
