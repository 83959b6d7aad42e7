"""Column expressions of the status domain and of its parsing."""
