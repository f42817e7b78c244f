"""Transaction-message analytics as Spark DataFrame transforms."""
