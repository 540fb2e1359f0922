"""Insurance pricing analytics as Spark DataFrame jobs."""
