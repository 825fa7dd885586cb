"""Recommendation analytics over user-item interaction tables, as Spark jobs."""
