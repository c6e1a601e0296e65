"""Token-usage analytics as plain Spark DataFrame transformations."""
