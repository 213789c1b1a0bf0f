"""Column expressions: naming, ids, JSON cells, masks flags, hashing, sampling."""
