"""Column functions: built-in Spark expressions, no Python in the row path."""
