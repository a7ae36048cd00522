"""Spark-first analytics over append-only activity evidence."""
