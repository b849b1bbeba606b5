"""Operators for training data: one module per operator, queries and their SQL in queries.py."""
