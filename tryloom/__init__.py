"""Build-attempt analytics as Spark jobs."""
