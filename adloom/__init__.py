"""Marketing-operations analytics as Spark DataFrame operators."""
