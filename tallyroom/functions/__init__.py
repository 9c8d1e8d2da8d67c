"""Column functions: rules over one row."""
