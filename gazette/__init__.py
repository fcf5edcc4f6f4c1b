"""gazette: notice analytics as Spark DataFrame and Structured Streaming operators."""
