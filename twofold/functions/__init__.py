"""Column expressions: hashed randomness, link functions, factor labels."""
