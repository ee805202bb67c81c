"""Column expressions of the aggregate algebra."""
