"""Coverline: news-coverage analytics as Spark jobs."""
