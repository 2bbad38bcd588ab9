"""Spark-first analytics over symbol scenes: matching, clustering, evaluation, grading and planning."""
