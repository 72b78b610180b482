"""Column functions: every one is a plain Spark expression, none is a Python UDF."""
