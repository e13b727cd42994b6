"""Column-level building blocks. Everything here is a plain Spark expression."""
