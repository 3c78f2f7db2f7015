"""Column functions: one row in, one value out, all built from built-in Spark expressions."""
