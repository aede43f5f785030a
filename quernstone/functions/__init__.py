"""Column functions and driver-side parsers of query text."""
