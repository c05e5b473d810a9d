"""Column functions: Columns in, Columns out."""
