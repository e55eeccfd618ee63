"""Datasets of question and SQL pairs on Spark: build, run, check, evolve and score."""
