"""Module-handbook analytics as Spark DataFrame jobs."""
