"""Column expressions: Columns in, Columns out, no shuffles."""
