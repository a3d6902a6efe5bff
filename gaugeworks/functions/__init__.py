"""Column functions: Spark expressions only."""
