"""Column expressions: everything here is a Spark expression, no Python UDF."""
