"""Column functions: identities, formats, values."""
