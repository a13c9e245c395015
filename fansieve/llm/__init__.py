"""Operators for training-data pipelines: each module holds one operator and the query that applies it."""
