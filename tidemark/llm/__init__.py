"""Operators for training-data and agent-memory corpora."""
