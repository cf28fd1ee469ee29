"""Column functions: vectors, decibels, identifiers, arrays."""
