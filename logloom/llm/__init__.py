"""Operators for training data: documents, conversations and benchmarks in, DataFrames out. Nothing else imports this."""
