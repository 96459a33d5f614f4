"""Gleaner: search, matching and exploratory analytics as plain Spark DataFrame functions."""
