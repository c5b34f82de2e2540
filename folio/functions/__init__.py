"""Column functions: everything here is a Spark expression."""
