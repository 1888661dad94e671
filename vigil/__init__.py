"""Vigil: access-log risk analytics as Spark jobs."""
