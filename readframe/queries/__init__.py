"""Queries over the test tables: each a Spark job with, where SQL can express it, the same result in plain SQL."""
