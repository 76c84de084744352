"""Spark-first analytics for content credibility, entity graphs, vectors and review queues."""
